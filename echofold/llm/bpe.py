"""Byte-level BPE through a pair occurrence index.

A block of rows is cut into pre-tokens by vectorised character-class rules, the distinct pre-tokens are laid out as one
linked list of symbols, and every adjacent pair with a merge rank is filed under that rank with all its positions. Ranks
are then applied once each, in ascending order, to all their positions at a time; the pairs that a merge creates have
higher ranks and are filed in turn. A row's ids are gathered from those of its pre-tokens.

Defined results: null text encodes as empty text (no ids, decoded as ""); rows are independent, so repeated rows repeat
their result; an empty table gives an empty table; other columns are not read. Memory follows block_bytes, or the
longest single text.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echofold.llm.batches import code_points, lean, slices, spans, utf8_view

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
UNKNOWN = 255
#: The white space of the pre-tokenizer's pattern, and its contractions.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NO_RANK = np.int32(2**31 - 1)

_classes = np.full(0x110000, UNKNOWN, np.uint8)
_classes[WHITE] = BLANK
_classes[0x20] = SPACE


def char_classes(cps: np.ndarray) -> np.ndarray:
    found = _classes[cps]
    if (new := found == UNKNOWN).any():
        for cp in np.unique(cps[new]).tolist():
            _classes[cp] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(cp))[0], OTHER)
        found = _classes[cps]
    return found


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def pre_tokens(raw: np.ndarray, offs: np.ndarray, special: list[bytes]) -> np.ndarray:
    """The byte at which each pre-token begins, in order; offs are the rows' bounds, which no pre-token crosses."""
    n_bytes = len(raw)
    if not n_bytes:
        return np.zeros(0, np.int64)
    cps, at = code_points(raw)
    n = len(cps)
    cut = np.zeros(n + 1, bool)  # a row or a special token begins or ends here
    cut[np.searchsorted(at, offs[offs < n_bytes])] = True
    cut[n] = True
    held: list[tuple[int, int]] = []
    if special:
        text = raw.tobytes()
        for token in special:
            found = text.find(token)
            while found >= 0:
                row = np.searchsorted(offs, found, "right")
                if found + len(token) <= offs[row]:
                    held.append((int(np.searchsorted(at, found)), int(np.searchsorted(at, found + len(token)))))
                    found += len(token) - 1
                found = text.find(token, found + 1)
        for a, b in held:
            cut[a] = cut[b] = True
    kind = char_classes(cps)
    white = kind >= SPACE
    before = np.concatenate([[UNKNOWN], kind[:-1]])  # class of the character before, none at a cut
    before[cut[:n]] = UNKNOWN
    joins = ~white & (before == SPACE)  # a word takes one plain space before it
    begin = np.where(white, (before < SPACE) | (before == UNKNOWN), (before != kind) & ~joins)
    begin[np.flatnonzero(joins) - 1] = True
    begin[np.flatnonzero(~white & (before == BLANK)) - 1] = True
    quote = np.flatnonzero((cps == 0x27) & begin)
    if len(quote):
        padded = np.concatenate([cps, np.zeros(3, np.uint32)])
        cuts = np.concatenate([cut, np.ones(3, bool)])
        for form in CONTRACTIONS:
            ok = np.ones(len(quote), bool)
            for k, c in enumerate(form[1:], 1):
                ok &= (padded[quote + k] == ord(c)) & ~cuts[quote + k]
            for k in range(1, len(form)):
                begin[quote[ok] + k] = False
            after = quote[ok] + len(form)
            begin[after[after < n]] = True
    for a, b in held:
        begin[a:b] = False
        begin[a] = True
    return at[np.flatnonzero(begin)]


class PairIndex:
    """A vocabulary with ranked merges, as read from a tokenizer.json of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        shown: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            shown[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            shown[i] = token
        self.bytes_of = pa.array(shown, pa.binary())
        self.of_byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * (self.size + 2) + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = np.append(keys[order], np.int64(2**62)), np.append(order.astype(np.int32), NO_RANK)
        pair = np.arange(65536)
        self.first = self._look(self.of_byte[pair >> 8], self.of_byte[pair & 255])

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.size + 2) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def encode_words(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes and bounds, and the bounds of each word's ids."""
        n, none, gone = len(raw), self.size, self.size + 1
        sym = np.append(self.of_byte[raw], np.int32(none))
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[n] = n
        prv = np.arange(-1, n, dtype=np.int32)
        full = offs[1:] > offs[:-1]
        nxt[offs[1:][full] - 1] = n
        prv[offs[:-1][full]] = n
        rank = np.full(n, NO_RANK, np.int32)
        if n > 1:
            rank[:-1] = self.first[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
            rank[nxt[:n] == n] = NO_RANK
        pos = np.flatnonzero(rank < NO_RANK).astype(np.int32)
        order = np.argsort(rank[pos], kind="stable")
        waiting = [(rank[pos][order], pos[order])]
        top = len(self.left)
        bounds = [b for b in (32, 64, 128, 256, 512, 1024, 2048, 4096, 6144, 8192, 12288, 16384, 20480, 24576, 32768, 40960) if b < top] + [top]
        for hi in bounds:
            ranks, at = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.int32),) * 2
            now = ranks < hi
            waiting = [(ranks[~now], at[~now])]
            self._apply(ranks[now], at[now], hi, sym, nxt, prv, n, gone, waiting)
        alive = sym[:n] < none
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], count[offs]

    def _apply(self, ranks, at, hi, sym, nxt, prv, n, gone, waiting) -> None:
        """Applies all pairs of a rank below hi, in ascending order; files new pairs of a rank of hi or more as waiting."""
        filed: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(r: np.ndarray, p: np.ndarray) -> None:
            order = np.argsort(r, kind="stable")
            r, p = r[order], p[order]
            edges = np.flatnonzero(r[1:] != r[:-1]) + 1
            begin = [0, *edges.tolist(), len(r)]
            for k, own in enumerate(r[begin[:-1]].tolist()):
                if own in filed:
                    filed[own].append(p[begin[k] : begin[k + 1]])
                else:
                    filed[own] = [p[begin[k] : begin[k + 1]]]
                    heapq.heappush(heap, own)

        if len(ranks):
            file(ranks, at)
        while heap:
            r = heapq.heappop(heap)
            lists = filed.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            second = nxt[pos]
            pos = pos[(sym[pos] == a) & (sym[second] == b)]
            if not len(pos):
                continue
            pos = np.sort(pos)
            pos = pos[np.append(True, pos[1:] != pos[:-1])]
            if a == b:  # in a run of equal symbols every other pair is taken, from the left
                follows = np.concatenate([[False], pos[1:] == nxt[pos[:-1]]])
                index = np.arange(len(pos))
                pos = pos[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            second = nxt[pos]
            third = nxt[second]
            sym[pos] = self.made[r]
            sym[second] = gone
            nxt[pos] = third
            prv[third] = pos
            touched = np.concatenate([prv[pos], pos])
            new = self._look(sym[touched], sym[nxt[touched]])
            has = new < NO_RANK
            if not has.any():
                continue
            new, touched = new[has], touched[has]
            near = new < hi
            if near.any():
                file(new[near], touched[near])
            if not near.all():
                waiting.append((new[~near], touched[~near]))

    def encode_block(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each column of texts: all ids, and the bounds of each row's ids."""
        words, codes, bounds = [], [], []
        for column in columns:
            raw, offs = utf8_view(column)
            begin = pre_tokens(raw, offs, list(self.special))
            ends = np.append(begin, len(raw)).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            words.append(tokens.dictionary)
            codes.append(tokens.indices.to_numpy(zero_copy_only=False))
            bounds.append(np.searchsorted(begin, offs))
        unified = pa.concat_arrays(words).dictionary_encode()
        distinct = unified.dictionary
        places = np.split(unified.indices.to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in words])[:-1])
        raw, offs = utf8_view(distinct)
        ids, first = self.encode_words(raw, offs)
        count = np.diff(first)
        first = first[:-1].copy()
        for token, i in self.special.items():
            k = distinct.index(pa.scalar(token, pa.binary())).as_py()
            if k >= 0:
                first[k], count[k] = len(ids), 1
                ids = np.append(ids, np.int32(i))
        for own, code, bound in zip(places, codes, bounds, strict=True):
            code = own[code]
            each = count[code]
            yield ids[spans(first[code], each)], np.concatenate([[0], np.cumsum(each)])[bound]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the rows' ids; bytes that are not UTF-8 come out as replacement characters."""
        shown = self.bytes_of.take(pa.array(ids))
        raw, offs = utf8_view(shown)
        joined = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(offs[bounds].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        try:
            joined.validate(full=True)
            return joined
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in joined.view(pa.binary()).to_pylist()], pa.string())


@lru_cache(maxsize=2)
def load(path: str) -> PairIndex:
    return PairIndex(path)


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for part in slices(batches, column, SLICE_BYTES):
        held.append(part)
        size += len(utf8_view(part.column(part.schema.get_field_index(column)))[0])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: key, n_tokens long, ids binary (little-endian unsigned 32-bit), and decoded string if asked for."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load(path)
        for block in _blocks(batches, "t"):
            for part, (ids, bounds) in zip(block, index.encode_block([p.column(1) for p in block]), strict=True):
                columns = [part.column(0), pa.array(np.diff(bounds)), _packed(ids, bounds)]
                if decoded:
                    columns.append(index.decode(ids, bounds))
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids", "decoded"][: len(columns)])

    schema = f"key {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(docs[key].alias("key"), docs[text].alias("t")).mapInArrow(lean(run), schema).withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and decoded string, from ids as encode() packs them; null ids decode as empty."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load(path)
        for part in slices(batches, "i", SLICE_BYTES):
            raw, offs = utf8_view(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), index.decode(np.frombuffer(raw.tobytes(), "<u4").astype(np.int32), offs // 4)], ["key", "decoded"])

    return tokens.select(tokens[key].alias("key"), tokens[ids].alias("i")).mapInArrow(lean(run), f"key {kind}, decoded string").withColumnRenamed("key", key)
