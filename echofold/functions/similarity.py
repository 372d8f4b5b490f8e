"""Jaro-Winkler for whole batches, and the score of two records by it.

All pairs of a batch move together: at step i the i-th characters of all left strings look for their partners at once.
Equal pairs in a batch are scored once. Half transpositions count, as the plain definition has them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOST_FROM, PREFIX, SCALE = 0.7, 4, 0.1


def _codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in values], np.int64)
    wide = max(1, int(size.max(initial=0)))
    out = np.zeros((len(values), wide), np.uint32)
    joined = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(wide) < size[:, None]] = joined
    return out, size


def jaro_winkler(left: list[str], right: list[str], chunk: int = 8192) -> np.ndarray:
    """The similarity of each pair."""
    if len(left) > chunk:
        return np.concatenate([jaro_winkler(left[k : k + chunk], right[k : k + chunk]) for k in range(0, len(left), chunk)])
    if not left:
        return np.zeros(0)
    (a, na), (b, nb) = _codes(left), _codes(right)
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    used_a, used_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    place = np.arange(b.shape[1])
    for i in range(a.shape[1]):
        free = (b == a[:, i, None]) & ~used_b & (np.abs(place - i) <= reach[:, None]) & (place < nb[:, None]) & (i < na)[:, None]
        hit = free.any(axis=1)
        used_a[hit, i] = True
        used_b[hit, free[hit].argmax(axis=1)] = True
    m = used_a.sum(axis=1)
    wide = int(m.max(initial=0))
    seq = np.zeros((2, len(left), max(1, wide)), np.uint32)
    for k, (x, used) in enumerate(((a, used_a), (b, used_b))):
        row, col = np.nonzero(used)
        seq[k][row, np.arange(len(row)) - np.searchsorted(row, row)] = x[row, col]
    t = ((seq[0] != seq[1]) & (np.arange(max(1, wide)) < m[:, None])).sum(axis=1)
    some = m > 0
    base = np.zeros(len(left))
    base[some] = (m[some] / na[some] + m[some] / nb[some] + (m[some] - t[some] / 2) / m[some]) / 3
    n = min(PREFIX, a.shape[1], b.shape[1])
    same = (a[:, :n] == b[:, :n]) & (np.arange(n) < np.minimum(na, nb)[:, None])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    out = np.where(base < BOOST_FROM, base, base + prefix * SCALE * (1 - base))
    out[np.array([x == y for x, y in zip(left, right, strict=True)])] = 1.0
    return out


@F.pandas_udf(T.DoubleType())
def _similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    ok = (left.notna() & right.notna()).to_numpy()
    pairs = list(zip(left[ok], right[ok], strict=True))
    place = {pair: k for k, pair in enumerate(dict.fromkeys(pairs))}
    scores = jaro_winkler([a for a, _ in place], [b for _, b in place])
    out = pd.Series(np.nan, index=left.index, dtype=float)
    out[ok] = scores[[place[p] for p in pairs]] if pairs else np.zeros(0)
    return out.astype(object).where(ok, None)


def similarity(left: Column, right: Column) -> Column:
    return _similarity(left, right)


def pair_scores(stored_name: Column, stored_symbol: Column, name: Column, symbol: Column, min_length: int = 3) -> Column:
    """Scores of name-name, symbol-symbol, name-symbol, symbol-name (stored first); null where a side is too short."""
    pairs = [(stored_name, name), (stored_symbol, symbol), (stored_name, symbol), (stored_symbol, name)]
    long = lambda x: F.when(F.length(x) >= min_length, x)
    return F.array(*[similarity(long(a), long(b)) for a, b in pairs])


FIELDS = ["name", "symbol", "name", "symbol"]


def recognised(scores: Column, bar: float) -> Column:
    """Stored fields in order of the first pairing at or over the bar."""
    hits = [F.when(scores[k] >= bar, F.lit(f)) for k, f in enumerate(FIELDS)]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def best(scores: Column, bar: float) -> Column:
    """The best score at or over the bar, or null."""
    return F.array_max(F.filter(scores, lambda x: x >= bar))


def narrative_match(scores: Column, bar: float, stored_uri: Column | None = None, uri: Column | None = None) -> Column:
    """struct(similarity, matchedOn), or null; the same non-empty URI is 1.0 on metadata."""
    found = F.when(F.size(recognised(scores, bar)) > 0, F.struct(best(scores, bar).alias("similarity"), recognised(scores, bar).alias("matchedOn")))
    if stored_uri is None or uri is None:
        return found
    return F.when((stored_uri != "") & (stored_uri == uri), F.struct(F.lit(1.0).alias("similarity"), F.array(F.lit("metadata")).alias("matchedOn"))).otherwise(found)
