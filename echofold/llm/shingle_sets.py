"""Shingle sets of texts, their fingerprints and minimum-hash bands, and exact similarity links among a few texts.

A set holds the distinct five-word shingles of a text (A-Z lower-cased, words split at ASCII white space; fewer words: the
whole sequence; none: the empty set) as 64-bit hashes. Two sets of similarity (Jaccard) J agree on a band of ROWS minima
with J ** ROWS, so with at least one of BANDS with 1 - (1 - J ** ROWS) ** BANDS, which is 0.9998 at J = 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from echofold.llm.batches import spans, sums, utf8_view
from echofold.llm.components import hook

WORDS = 5
FP_WORDS = 2  # 64-bit words of a fingerprint
BANDS, ROWS = 16, 4
_MULTIPLY = np.random.default_rng(29).integers(1, 2**63, BANDS * ROWS + FP_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(28))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def sets_of(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and the texts' bounds among them."""
    raw, offs = utf8_view(column)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8).tobytes()
    of = xxhash.xxh64_intdigest
    known: dict[bytes, int] = {}
    hashes, count = [], np.zeros(len(offs) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        own = low[a:b].split()
        count[i] = len(own)
        for w in own:
            h = known.get(w)
            if h is None:
                known[w] = h = of(w)
            hashes.append(h)
    word = np.array(hashes, np.uint64)
    first = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    start = spans(first[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    size = np.minimum(count, words)[row]
    code = size.astype(np.uint64)
    for k in range(words):
        inside = k < size
        code = np.where(inside, mixed(code * _BASE + word[np.where(inside, start + k, 0)]) if len(word) else code, code)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)]
    row, code = row[keep], code[keep]
    return code, np.searchsorted(row, np.arange(len(n) + 1))


def fingerprints(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """FP_WORDS words of majority bits for each set."""
    out = np.zeros((len(bounds) - 1, FP_WORDS), np.uint64)
    for w in range(FP_WORDS):
        bits = np.unpackbits(mixed(code * _MULTIPLY[w]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.zeros((len(bounds) - 1, 64), np.int32)
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(full):
            ones[full] = np.add.reduceat(bits, bounds[full], axis=0, dtype=np.int32)
        out[:, w] = np.packbits(ones * 2 > np.diff(bounds)[:, None], axis=1).view(">u8").ravel()
    return out


def bands(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each set that is not empty (zeros for those that are)."""
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    spread = mixed(code)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for k in range(ROWS):
            least = np.minimum.reduceat(mixed_fast(spread, _MULTIPLY[FP_WORDS + b * ROWS + k]), bounds[full]) if len(full) else key
            key = mixed(key * _BASE + least)
        out[full, b] = key
    return out


def mixed_fast(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = h * by
    return (h ^ (h >> np.uint64(32))) * _BASE


def digests(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each whole set: equal sets have the same."""
    raw = memoryview(code.tobytes())
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64)


def similar(side: np.ndarray, fp: np.ndarray, code: np.ndarray, bounds: np.ndarray, least: float, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of sets that span the same components as all pairs with a similarity of least or more among those
    whose fingerprints differ in budget bits or fewer. side: 0 or 1; where both occur, pairs of one side are passed over.

    Each set is held in turn against the later ones that it isn't linked to yet, at once.
    """
    n = len(side)
    root, size = np.arange(n), np.diff(bounds)
    found_i, found_j = [], []
    both = side.any() and not side.all()
    ids = np.unique(code, return_inverse=True)[1]
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        ok = (root[j] != root[i]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
        if both:
            ok &= side[j] != side[i]
        j = j[ok]
        j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(axis=1) <= budget]
        if not len(j):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        mark[own] = True
        place = spans(bounds[j], size[j])
        shared = sums(mark[ids[place]].astype(np.int64), np.concatenate([[0], np.cumsum(size[j])]))
        mark[own] = False
        j = j[shared >= least * (size[i] + size[j] - shared) - 1e-9]
        if len(j):
            found_i.append(np.full(len(j), i))
            found_j.append(j)
            root = hook(root, found_i[-1], j)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return i, j
