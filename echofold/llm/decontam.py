"""Benchmark decontamination: documents that hold a benchmark item within EDITS of its length in edits.

Texts are compared as symbols: lower-cased letters and numbers, each run of others one blank. An item of m symbols found
with k edits shares all but kq of any of its q-grams with the document, on diagonals no more than k apart (the q-gram
lemma); k is EDITS of m, rounded down. Shared q-grams are counted, each place of the item once, in overlapping bands of
2(k + 1) diagonals; bands that reach the bound are regions to verify, by alignment in the band with free ends in the document.

Phrases that many items share would make every document that holds one a candidate for all of them. So an item's hot grams,
those of more than HOT places in the block, are left out of its index and its count: the bound is that of the cold ones, their
number less kq. An item takes q = Q if that leaves a bound of GOOD_BOUND, else the first of SHORTER that does, else the first
that leaves any. Items of which too little is cold (templates that differ in a few symbols) keep all their grams in indexes of
HEAVY_ITEMS items each. Equal items are one in the index. Postings are expanded CHUNK at a time, in stretches of a text that
overlap by the longest region, so memory doesn't follow a phrase's number of occurrences. The filter loses nothing; the
alignment decides.

The index of a block of items (BLOCK_SYMBOLS at most, expected) goes to the executors, so neither side is shuffled and no pair
list is made; a larger benchmark is more blocks, each a pass over the texts that is written before the next one's index goes
out. Where documents are filtered by several blocks, the passes write digests of the texts that hold an item, and the
documents are read once more to drop those.

Defined results: items with fewer than MIN_WORDS words, or null, are not searched; null text holds no item; an item that
occurs several times in a document is one row, with the fewest edits; repeated rows repeat their rows; equal items are rows
of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.batches import code_points, lean, slices, spans, utf8_view
from echofold.llm.bpe import LETTER, NUMBER, char_classes
from echofold.llm.storage import settled

Q, SHORTER, HEAVY_Q = 8, (5, 4, 3), 5
HOT, GOOD_BOUND, HEAVY_ITEMS, CHUNK = 64, 4, 512, 1 << 20
LEAKY_BROADCAST = 500_000
EDITS = 0.1
MIN_WORDS = 5
BLOCK_SYMBOLS = 2_000_000
SLICE_BYTES = 1 << 20
VERIFY_AT_ONCE = 512
FILTER_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (no blank at a text's start), and the texts' bounds."""
    raw, offs = utf8_view(pc.utf8_lower(column))
    cps, at = code_points(raw)
    bounds = np.searchsorted(at, offs)
    kind = char_classes(cps)
    word = (kind == LETTER) | (kind == NUMBER)
    first = np.zeros(len(cps) + 1, bool)
    first[bounds] = True
    keep = word | (np.append(False, word[:-1])[: len(word)] & ~first[:-1])
    return np.where(word, cps, 32)[keep].astype(np.uint32), np.concatenate([[0], np.cumsum(keep)])[bounds]


def qgrams(text: np.ndarray, q: int = Q) -> np.ndarray:
    """The q symbols (8 at most) from each place as one integer, a byte for each; other symbols may share a byte, which only adds candidates."""
    w = ((text ^ (text >> 8)) & 0xFF).astype(np.uint64)
    n = len(w) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q == 8:
        for shift in (1, 2, 4):
            w = w[:-shift] | (w[shift:] << np.uint64(8 * shift))
        return w
    out = w[:n].copy()
    for k in range(1, q):
        out |= w[k : k + n] << np.uint64(8 * k)
    return out


@dataclass
class Grams:
    """Q-grams of some items, at some of their places: each gram's postings, as item and place, and each item's bound."""

    q: int
    gram: np.ndarray
    at: np.ndarray  # bounds of each gram's postings
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray  # by item
    reach: int  # the symbols of a text that a region can cover
    seen: np.ndarray  # a bit table of the grams

    @classmethod
    def of(cls, q: int, gram: np.ndarray, item: np.ndarray, place: np.ndarray, need: np.ndarray, reach: int) -> Grams:
        order = np.argsort(gram, kind="stable")
        distinct, at = np.unique(gram[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(distinct * _SPREAD) >> np.uint64(64 - FILTER_BITS)] = True
        return cls(q, distinct, np.append(at, len(gram)), item[order], place[order], need, reach, seen)


def places(text: np.ndarray, q: int, use: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, item, place) of all q-grams of the items use."""
    count = np.maximum(size[use] - q + 1, 0)
    start, item = spans(first[use], count), np.repeat(use, count)
    return qgrams(text, q)[start] if len(start) else np.zeros(0, np.uint64), item, start - first[item]


def indexes(text: np.ndarray, first: np.ndarray, size: np.ndarray, edits: np.ndarray) -> list[Grams]:
    """Indexes that hold each item once."""
    left, out = np.arange(len(size)), []
    for q, least in [(Q, GOOD_BOUND), *((q, GOOD_BOUND) for q in SHORTER), (Q, 1), *((q, 1) for q in SHORTER)]:
        if not len(left):
            break
        gram, item, place = places(text, q, left, first, size)
        _, slot, count = np.unique(gram, return_inverse=True, return_counts=True)
        cold = count[slot] <= HOT
        need = np.bincount(item[cold], minlength=len(size)) - edits * q
        own = np.zeros(len(size), bool)
        own[left] = need[left] >= least
        pick = cold & own[item]
        if pick.any():
            reach = int((size + 2 * edits)[own].max()) + 2
            out.append(Grams.of(q, gram[pick], item[pick], place[pick], need, reach))
        left = left[~own[left]]
    for k in range(0, len(left), HEAVY_ITEMS):
        own = left[k : k + HEAVY_ITEMS]
        out.append(Grams.of(HEAVY_Q, *places(text, HEAVY_Q, own, first, size), size - HEAVY_Q + 1 - edits * HEAVY_Q, int((size + 2 * edits)[own].max()) + 2))
    return out


@dataclass
class Items:
    """A block of items, indexed by q-gram. Items that are equal as symbols are one in all but ids, sizes and twins."""

    ids: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    first: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    twins: np.ndarray  # places in ids, by item
    twins_at: np.ndarray
    grams: list[Grams]

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        text, bounds = symbols(pa.array(texts, pa.string()))
        blank = np.append(0, np.cumsum(text == 32))
        first, size = bounds[:-1], np.diff(bounds)
        size = size - ((size > 0) & (text[np.maximum(bounds[1:] - 1, 0)] == 32) if len(text) else 0)
        words = blank[first + size] - blank[first] + 1
        use = np.flatnonzero(words >= MIN_WORDS)  # so 9 symbols at least
        first, size = first[use], size[use]
        known: dict[bytes, int] = {}
        item = np.array([known.setdefault(text[a : a + n].tobytes(), len(known)) for a, n in zip(first, size, strict=True)], np.int64)
        one = np.unique(item, return_index=True)[1]
        twins = np.argsort(item, kind="stable")
        edits = (size[one] * EDITS).astype(np.int64)
        return cls(np.array(ids, object)[use], size, text, first[one], size[one], edits, twins, np.append(0, np.cumsum(np.bincount(item, minlength=len(one)))), indexes(text, first[one], size[one], edits))


def align(items: Items, item: np.ndarray, text: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Fewest edits of items[item[c]] in text[lo[c]:hi[c]], over the width diagonals from base[c]; free ends in the text."""
    m = items.size[item]
    rows = np.arange(width)
    D = np.zeros((len(item), width), np.int32)
    best = np.full(len(item), np.iinfo(np.int32).max)
    for i in range(int(m.max())):
        live = m > i
        symbol = items.text[np.where(live, items.first[item] + i, 0)]
        at = base[:, None] + i + rows
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        differs = ~inside | (text[np.clip(at, 0, len(text) - 1)] != symbol[:, None])
        new = D + differs
        new[:, :-1] = np.minimum(new[:, :-1], D[:, 1:] + 1)
        new = np.minimum.accumulate(new - rows, axis=1) + rows
        D = np.where(live[:, None], new, D)
        done = m == i + 1
        best[done] = D[done].min(axis=1)
    return best


def regions(items: Items, grams: Grams, gram: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, band) of all bands of diagonals that hold the lemma's number of shared q-grams; gram: those of the text."""
    if not len(grams.gram) or not len(gram):
        return
    near = np.flatnonzero(grams.seen[(gram * _SPREAD) >> np.uint64(64 - FILTER_BITS)])
    slot = np.searchsorted(grams.gram, gram[near])
    ok = grams.gram[np.minimum(slot, len(grams.gram) - 1)] == gram[near]
    near, slot = near[ok], slot[ok]
    row = np.searchsorted(bounds, near, "right") - 1
    ok = near + grams.q <= bounds[row + 1]
    near, slot, row = near[ok], slot[ok], row[ok]
    count = grams.at[slot + 1] - grams.at[slot]
    ends = np.cumsum(count)
    a, n_items, longest = 0, len(items.size), int(items.size.max())
    while a < len(near):
        # a region's grams lie within reach, so each is whole in one of stretches that overlap by that
        to = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")), int(np.searchsorted(near, near[a] + 2 * grams.reach)), a + 1)
        own, own_count = slice(a, to), count[a:to]
        post = spans(grams.at[slot[own]], own_count)
        item, place = grams.item[post], grams.place[post]
        band = (np.repeat(near[own], own_count) - place + longest) // (items.edits[item] + 1)  # not negative
        n_bands = int(band.max()) + 2
        group = (np.repeat(row[own], own_count) * n_items + item) * n_bands
        after = band > 0
        key, at, hits = np.unique(np.concatenate([group + band, (group + band - 1)[after]]), return_inverse=True, return_counts=True)
        pair, band = key // n_bands, key % n_bands
        need = grams.need[pair % n_items]
        ok = hits >= need
        if ok.any():  # of a gram that the text repeats, each place of the item counts once
            pick = ok[at]
            once = np.unique(at[pick] * longest + np.concatenate([place, place[after]])[pick])
            ok = np.bincount(once // longest, minlength=len(key)) >= need
            yield pair[ok] // n_items, pair[ok] % n_items, band[ok]
        if to >= len(near):
            return
        a = max(a + 1, int(np.searchsorted(near, near[to] - grams.reach)))


def leaks(items: Items, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in items.ids, edits) for each text and each item that it holds."""
    text, bounds = symbols(column)
    held = [[np.zeros(0, np.int64)] for _ in range(3)]
    of_q = {q: qgrams(text, q) for q in {g.q for g in items.grams}}
    for grams in items.grams:
        for row, item, band in regions(items, grams, of_q[grams.q], bounds):
            edits = items.edits[item]
            base = band * (edits + 1) - int(items.size.max()) - edits
            width = 4 * edits + 2
            order = np.argsort(items.size[item], kind="stable")
            for k in range(0, len(order), VERIFY_AT_ONCE):
                c = order[k : k + VERIFY_AT_ONCE]
                found = align(items, item[c], text, base[c], bounds[row[c]], bounds[row[c] + 1], int(width[c].max()))
                ok = found <= edits[c]
                for kept, value in zip(held, (row[c][ok], item[c][ok], found[ok]), strict=True):
                    kept.append(value)
    row, item, found = (np.concatenate(x) for x in held)
    order = np.lexsort((found, item, row))
    row, item, found = row[order], item[order], found[order]
    first = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))[: len(row)]
    row, item, found = row[first], item[first], found[first]
    count = items.twins_at[item + 1] - items.twins_at[item]
    return np.repeat(row, count), items.twins[spans(items.twins_at[item], count)], np.repeat(found, count)


def cut(items: DataFrame, key: str, text: str, symbols_a_block: int) -> tuple[DataFrame, int]:
    """The items that are not null, as key and t, and the number of their blocks."""
    rows = items.where(items[text].isNotNull()).select(items[key].alias("key"), items[text].alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    return rows, max(1, -(-total // symbols_a_block))


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", symbols_a_block: int = BLOCK_SYMBOLS) -> Iterator[Items]:
    """The items in blocks; each is collected alone."""
    rows, n = cut(items, key, text, symbols_a_block)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("key", "t"), F.lit(n)) == k).orderBy("key", "t").collect()
        yield Items.of([r.key for r in own], [r.t for r in own])


def passes(rows: DataFrame, items: DataFrame, item: str, run, schema: str, symbols_a_block: int) -> DataFrame:
    """The rows of run(block, batches) for all blocks of items. Of several, each is written before the next block goes out."""
    out, alone = None, cut(items, item, "text", symbols_a_block)[1] == 1
    for block in blocks(items, item, symbols_a_block=symbols_a_block):
        held = rows.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(lean(lambda batches, held=held: run(held.value, batches)), schema)
        if not alone:
            found = settled(found, "decontam")
            held.unpersist()
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", symbols_a_block: int = BLOCK_SYMBOLS) -> DataFrame:
    """Rows key, item, edits int, similarity double (1 - edits / the item's symbols) for each document and item that it holds."""
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("t"))
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[1], pa.string())

    def run(own: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE_BYTES):
            row, at, edits = leaks(own, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(own.ids[at].tolist(), kind), pa.array(edits.astype(np.int32)), pa.array(1 - edits / own.sizes[at])], ["key", "item", "edits", "similarity"])

    found = passes(rows, items, item, run, f"key {kinds[0]}, item {kinds[1]}, edits int, similarity double", symbols_a_block)
    return found.withColumnsRenamed({"key": key, "item": item})


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", symbols_a_block: int = BLOCK_SYMBOLS) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    if cut(items, "item_id", "text", symbols_a_block)[1] == 1:
        at = docs.columns.index(text)

        def clean(own: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text, SLICE_BYTES):
                stays = np.ones(part.num_rows, bool)
                stays[leaks(own, part.column(at))[0]] = False
                yield part.filter(pa.array(stays))

        return passes(docs, items, "item_id", clean, docs.schema, symbols_a_block)

    def digests(own: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE_BYTES):
            texts = part.column(0).take(pa.array(np.unique(leaks(own, part.column(0))[0]))).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())], ["digest"])

    leaky = settled(passes(docs.select(docs[text].alias("t")), items, "item_id", digests, "digest string", symbols_a_block).distinct(), "leaky")
    leaky = F.broadcast(leaky) if leaky.count() <= LEAKY_BROADCAST else leaky
    return docs.join(leaky, F.sha2(docs[text].cast("binary"), 256) == leaky["digest"], "left_anti")
