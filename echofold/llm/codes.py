"""Vector code compression: each vector as one byte a part, the nearest entry of that part's codebook, in whole numbers.

A component x becomes floor(256 x); a vector is cut into PARTS equal consecutive parts. Each part's codebook starts as that
part of the ENTRIES vectors of smallest keys. In each of ROUNDS rounds the codebooks go to the tasks as kd-trees; every part
finds its nearest entry (squared Euclidean distance, ties to the lower index) by branch and bound; and the tasks' whole sums
and counts by entry, added up by Spark, make the next entries: floor(sum / count), where an entry was used at all. The tables
that reach the driver or go out from it hold ENTRIES entries a part, whatever the number of rows.

The search first goes down to the leaf on a part's own side of each cut, which gives a first bound, then walks the tree into
every node whose box is no farther than the best so far. Boxes at exactly that distance are entered, as they can hold an entry
of a lower index.

Defined results: rows whose vector is null, empty or of another size than most, or holds a null or non-finite component, are
dropped; ties between sizes go to the smaller. A null key comes after all others; of equal keys the smaller vector comes
first; repeated rows are rows of their own. A size that PARTS does not divide is filled up with zeros. Fewer rows than ENTRIES
are as many entries. Components so large that distances or their sums pass a long raise ArithmeticError. An empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.ann import matrix
from echofold.llm.storage import settled
from echofold.llm.vectors import finite, main_size

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4
FAR = np.iinfo(np.int64).max
HEAVY_LABELS = 10_000


class Tree:
    """A kd-tree over the entries of a codebook; nodes are numbered from the root, 0, and know the box of their entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.own: list[np.ndarray] = []  # of a leaf: its entries, ascending
        self.axis, self.cut, self.low, self.high = [], [], [], []
        self._grow(np.arange(len(entries)))
        self.axis, self.cut, self.low, self.high = (np.array(x) for x in (self.axis, self.cut, self.low, self.high))
        self.lo, self.hi = (np.array([f(entries[own], axis=0) for own in self.own]) for f in (np.min, np.max))

    def _grow(self, own: np.ndarray) -> int:
        node = len(self.own)
        width = self.entries[own].max(axis=0) - self.entries[own].min(axis=0)
        axis = int(width.argmax())
        values = np.sort(self.entries[own, axis])
        cut = values[(len(own) - 1) // 2]
        if cut == values[-1]:  # so that both sides have entries
            cut = values[max(0, np.searchsorted(values, cut) - 1)]
        leaf = len(own) <= LEAF or not width[axis]
        for held, value in ((self.own, own), (self.axis, -1 if leaf else axis), (self.cut, cut), (self.low, -1), (self.high, -1)):
            held.append(value)
        if not leaf:
            below = self.entries[own, axis] <= cut
            self.low[node], self.high[node] = self._grow(own[below]), self._grow(own[~below])
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry, of several the lowest, and its squared distance."""
        best, at = np.full(len(points), FAR), np.full(len(points), len(self.entries))

        def look(node: int, rows: np.ndarray) -> None:
            own = self.own[node]
            far = np.zeros((len(rows), len(own)), np.int64)
            for d in range(points.shape[1]):
                far += (points[rows, d, None] - self.entries[own, d]) ** 2
            pick = far.argmin(axis=1)
            far, pick = far[np.arange(len(rows)), pick], own[pick]
            new = (far < best[rows]) | ((far == best[rows]) & (pick < at[rows]))
            best[rows[new]], at[rows[new]] = far[new], pick[new]

        home = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(rows := rows[self.axis[home[rows]] >= 0]):
            node = home[rows]
            home[rows] = np.where(points[rows, self.axis[node]] <= self.cut[node], self.low[node], self.high[node])
        order = np.argsort(home, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(rows):
                look(home[rows[0]], rows)
        walk = [(0, np.arange(len(points)))]
        while walk:
            node, rows = walk.pop()
            gap = np.maximum(np.maximum(self.lo[node] - points[rows], points[rows] - self.hi[node]), 0)
            rows = rows[(gap * gap).sum(axis=1) <= best[rows]]
            if self.axis[node] < 0:
                rows = rows[home[rows] != node]
                if len(rows):
                    look(node, rows)
            elif len(rows):
                walk += [(self.low[node], rows), (self.high[node], rows)]
        return at, best


@dataclass
class Codebooks:
    """The entries of all parts, as part, entry, place in the part; and the size of the vectors that they are for."""

    entries: np.ndarray
    size: int

    def sha256(self) -> str:
        """Of all entries' numbers in that order, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of codes stand for."""
        parts = np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1)
        return parts[:, : self.size] / SCALE


def whole(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Rows as whole numbers, by part."""
    x = np.floor(vectors * SCALE).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return x.reshape(len(x), parts, x.shape[1] // parts)


def kept(rows: DataFrame, key: str, vector: str, *also: str) -> tuple[DataFrame, int]:
    """key, v and the columns also (as c0, c1, ...) of the rows that take part, and the vectors' size."""
    own = rows.select(rows[key].alias("key"), rows[vector].alias("v"), *[rows[c].alias(f"c{k}") for k, c in enumerate(also)]).where(finite(F.col("v")))
    size, count, largest = main_size(own, "v")
    if size and max(size, count) * (2 * SCALE * (largest + 1)) ** 2 >= 2**63:
        raise ArithmeticError(f"components of up to {largest} have distances, or sums of them, past a long")
    return own.where(F.size("v") == size), size


def train(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a table after so many rounds. entries: 256 at most."""
    own, size = kept(rows, key, vector)
    first = own.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = whole(np.array([r.v for r in first], np.float64).reshape(len(first), size), parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        held = rows.sparkSession.sparkContext.broadcast([Tree(book) for book in books])
        n, width = books.shape[1:]

        def add(batches: Iterator[pa.RecordBatch], held=held, n=n, width=width) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = whole(matrix(batch.column(0)), parts)
                    for p, tree in enumerate(held.value):
                        slot = p * n + tree.nearest(x[:, p])[0]
                        count += np.bincount(slot, minlength=parts * n)
                        np.add.at(total, slot, x[:, p])
            used = np.flatnonzero(count)
            place = np.tile(np.arange(width), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(used, width), place, np.repeat(count[used], width), total[used].ravel())], ["slot", "place", "n", "total"])

        sums = own.select("v").mapInArrow(add, "slot long, place long, n long, total long").groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        found = sums.toArrow()  # a row for each component of the codebooks at most
        slot, place, count, total = (found[c].to_numpy() for c in ("slot", "place", "n", "total"))
        books = books.copy()
        books[slot // n, slot % n, place] = total // count
        held.unpersist()
    return Codebooks(books, size)


def compress(rows: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", *also: str) -> DataFrame:
    """key, code string (two hex digits a part), error long, and the columns also, of the rows that take part."""
    own = rows.select(rows[key].alias("key"), rows[vector].alias("v"), *[rows[c].alias(f"c{k}") for k, c in enumerate(also)])
    own = own.where(finite(F.col("v")) & (F.size("v") == books.size))
    held = rows.sparkSession.sparkContext.broadcast([Tree(book) for book in books.entries] if books.size else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(matrix(batch.column(1)), len(held.value))
                code, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
                for p, tree in enumerate(held.value):
                    at, far = tree.nearest(x[:, p])
                    code[:, p] = at
                    error += far
                text = code.tobytes().hex()
                wide = 2 * code.shape[1]
                codes = pa.array([text[k : k + wide] for k in range(0, len(text), wide)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), codes, pa.array(error), *batch.columns[2:]], ["key", "code", "error", *[f"c{k}" for k in range(len(also))]])

    kinds = [f"c{k} {own.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(also))]
    found = own.mapInArrow(run, ", ".join([f"key {own.schema['key'].dataType.simpleString()}", "code string", "error long", *kinds]))
    return found.withColumnsRenamed({"key": key} | {f"c{k}": c for k, c in enumerate(also)})


def with_group_error(found: DataFrame, group: str, error: str = "error", out: str = "label_error") -> DataFrame:
    """found with its error summed over equal values of group, nulls together. The HEAVY_LABELS values of most rows are
    joined from a broadcast; each of the others, if there are more, holds that share of the rows at most, so they are shuffled."""
    found = settled(found, "codes")
    sums = settled(found.groupBy(F.col(group).alias("_group")).agg(F.sum(error).alias(out), F.count("*").alias("_n")), "code-sums")
    if sums.count() <= HEAVY_LABELS:
        return found.join(F.broadcast(sums.drop("_n")), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    heavy = F.broadcast(settled(sums.orderBy(F.desc("_n"), "_group").limit(HEAVY_LABELS).select("_group", F.col(out).alias("_heavy")), "code-heavy"))
    first = found.join(heavy, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    done = first.where("_heavy IS NOT NULL").withColumnRenamed("_heavy", out)
    rest = first.where("_heavy IS NULL").drop("_heavy").join(sums.drop("_n"), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return done.unionByName(rest)


_PLACES = range(1, 5)
#: The same in SQL, for vectors of 64 components and keys that differ.
ORACLE_SQL = f"""WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
part AS (SELECT vec_id, label, p, {", ".join(f"x[4 * p + {i}] AS v{i}" for i in _PLACES)} FROM whole, range({PARTS}) AS r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, {", ".join(f"v{i}" for i in _PLACES)} FROM part QUALIFY k < {ENTRIES}),
""" + ",\n".join(
    f"""near{r} AS (SELECT vec_id, p, min(({" + ".join(f"(a.v{i} - b.v{i}) * (a.v{i} - b.v{i})" for i in _PLACES)}) * {ENTRIES} + k) AS found FROM part a JOIN book{r} b USING (p) GROUP BY vec_id, p)"""
    + (
        f""",
sum{r} AS (SELECT p, found % {ENTRIES} AS k, {", ".join(f"CAST(floor(sum(v{i}) / count(*)) AS BIGINT) AS v{i}" for i in _PLACES)} FROM near{r} JOIN part USING (vec_id, p) GROUP BY p, k),
book{r + 1} AS (SELECT b.p, b.k, {", ".join(f"coalesce(s.v{i}, b.v{i}) AS v{i}" for i in _PLACES)} FROM book{r} b LEFT JOIN sum{r} s USING (p, k))"""
        if r < ROUNDS
        else ""
    )
    for r in range(ROUNDS + 1)
) + f""",
told AS (SELECT vec_id, string_agg(printf('%02x', found % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(found // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg({" || ',' || ".join(f"v{i}" for i in _PLACES)}, ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM told JOIN whole USING (vec_id), sha"""
