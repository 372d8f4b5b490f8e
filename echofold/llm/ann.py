"""Approximate nearest neighbours by learned partitions, nearness being the largest inner product.

On a bounded sample (SAMPLE_A_PART rows for each part, so at most MOST_PARTS times that) a neighbour graph is cut into
balanced parts (recursive bisection: a principal direction's median, then swaps of equal numbers that gain the most
edges); a small network learns, for each vector, in which parts its neighbours lie. It gives every row of the table its
most probable part, and each query its `probes` most probable ones, in which all rows are ranked exactly in double
precision; where those hold too few rows, further parts, so that every query gets k while the table has as many. `probes` is
the least number with which the exact nearest neighbours, in the whole table, of CALIBRATION rows that the router was not
fitted on are found to a share of TARGET. A part is ranked in cells of CELL_ROWS rows and CELL_ROWS queries at most (expected), so a hot
part is many tasks; each cell returns the k best of each query, which are merged.

Defined results: a vector that is null, zero, of another size than most, or with a null or non-finite component takes no
part, as row or query, nor does a row with a null key; ties go to the smaller key; rows with the query's key are its own;
repeated rows are rows of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from echofold.llm.storage import settled

LEAST_SAMPLE, SAMPLE_A_PART = 8192, 64
CALIBRATION = 256
PART_ROWS = 8192
LEAST_PARTS, MOST_PARTS = 8, 1024
DEGREE = 16
HIDDEN = 96
EPOCHS = 30
TARGET = 0.93
CELL_ROWS = 20_000
QUERIES_AT_ONCE = 128


def top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k]


def graph(X: np.ndarray, degree: int) -> np.ndarray:
    """The degree nearest others of each row."""
    out = np.empty((len(X), degree), np.int64)
    for a in range(0, len(X), 1024):
        s = X[a : a + 1024] @ X.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = top(s, degree)
    return out


def bisect(X: np.ndarray, near: np.ndarray, nodes: np.ndarray, passes: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """nodes in two halves with few edges of near between them."""
    own = X[nodes] - X[nodes].mean(axis=0)
    axis = np.linalg.svd(own.T @ own)[0][:, 0]
    side = np.zeros(len(nodes), bool)
    side[np.argsort(own @ axis, kind="stable")[len(nodes) // 2 :]] = True
    place = np.full(len(X), -1)
    place[nodes] = np.arange(len(nodes))
    to = place[near[nodes]]
    here = np.repeat(np.arange(len(nodes)), near.shape[1])[to.ravel() >= 0]
    to = to.ravel()[to.ravel() >= 0]
    for _ in range(passes):
        cross = (side[here] != side[to]).astype(float) * 2 - 1
        gain = np.bincount(here, cross, len(nodes)) + np.bincount(to, cross, len(nodes))
        a, b = (np.flatnonzero(side == s) for s in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b), max(1, len(nodes) // 20))
        n = int((gain[a[:n]] + gain[b[:n]] > 2).sum())
        if not n:
            break
        side[a[:n]], side[b[:n]] = True, False
    return nodes[~side], nodes[side]


def partition(X: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row; sizes differ by one a level at most. parts is a power of two."""
    groups = [np.arange(len(X))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(X, near, g)]
    out = np.empty(len(X), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Router:
    """A network with one hidden layer, and the number of parts to search."""

    A: np.ndarray
    a: np.ndarray
    B: np.ndarray
    b: np.ndarray
    probes: int = 1

    def logits(self, X: np.ndarray) -> np.ndarray:
        return np.maximum(self._unit(X) @ self.A + self.a, 0) @ self.B + self.b

    @staticmethod
    def _unit(X: np.ndarray) -> np.ndarray:
        return (X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-30)).astype(np.float32)

    @classmethod
    def fit(cls, X: np.ndarray, target: np.ndarray, seed: int = 5) -> Router:
        rng = np.random.default_rng(seed)
        unit, parts = cls._unit(X), target.shape[1]
        p = [rng.normal(0, X.shape[1] ** -0.5, (X.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
        p = [x.astype(np.float32) for x in p]
        m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(X))
            for k in range(0, len(X), 128):
                own = order[k : k + 128]
                h = np.maximum(unit[own] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = (z / z.sum(axis=1, keepdims=True) - target[own]) / len(own)
                dh = (d @ p[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((unit[own].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g**2 - v[i])
                    p[i] -= 5e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return cls(*p)


def learn(X: np.ndarray, parts: int) -> Router:
    """A router fitted on sample X; its probes search all parts until calibrated."""
    degree = min(DEGREE, len(X) - 1)
    near = graph(X, degree)
    part = partition(X, near, parts)
    target = np.zeros((len(X), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(X)), degree), part[near].ravel()), 1 / (degree + 1))
    np.add.at(target, (np.arange(len(X)), part), 1 / (degree + 1))
    router = Router.fit(X, target)
    router.probes = parts
    return router


def calibrated(router: Router, routed: DataFrame, keys: np.ndarray, Q: np.ndarray, k: int) -> Router:
    """router with the least probes that find TARGET of the k nearest of the rows Q (their keys: keys) in routed."""
    spark, parts = routed.sparkSession, len(router.b)
    held = spark.sparkContext.broadcast((keys, Q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, Q = held.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        for batch in batches:
            if batch.num_rows:
                key, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                q, x, score = best_of(np.arange(len(Q)), Q, key, matrix(batch.column(1)), k + 1, keys)
                order = np.argsort(key, kind="stable")
                new = [q, x, score, part[order][np.searchsorted(key[order], x)]]
                kept = [np.concatenate(y) for y in zip(kept, new, strict=True)]
                order = np.lexsort((kept[1], -kept[2], kept[0]))
                kept = [y[order] for y in kept]
                first = np.arange(len(order)) - np.searchsorted(kept[0], kept[0]) < k
                kept = [y[first] for y in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["q", "x", "score", "part"])

    found = routed.select("key", "v", "part").mapInArrow(nearest, "q long, x long, score double, part int")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "x"))).where(F.col("n") <= k).select("q", "part").toArrow()  # CALIBRATION * k rows at most
    if not len(found):
        return router
    rank = np.argsort(np.argsort(-router.logits(Q), axis=1, kind="stable"), axis=1, kind="stable")
    needed = rank[found["q"].to_numpy(), found["part"].to_numpy()]
    router.probes = next((p for p in range(1, parts) if (needed < p).mean() >= TARGET), parts)
    return router


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def best_of(query: np.ndarray, Q: np.ndarray, key: np.ndarray, X: np.ndarray, k: int, own_key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, score) of each query's k nearest rows of other keys; scores don't depend on what else is ranked.
    own_key: the queries' keys, where query is not."""
    own_keys = query if own_key is None else own_key
    out, longest = [], np.sqrt((X * X).sum(axis=1)).max(initial=0)
    for a in range(0, len(Q), QUERIES_AT_ONCE):
        own, ids = Q[a : a + QUERIES_AT_ONCE], query[a : a + QUERIES_AT_ONCE]
        s = own @ X.T
        s[own_keys[a : a + QUERIES_AT_ONCE, None] == key[None, :]] = -np.inf
        least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
        slack = 4 * np.finfo(float).eps * X.shape[1] * longest * np.sqrt((own * own).sum(axis=1))  # more than sums in another order differ by
        row, col = np.nonzero((s >= np.where(np.isfinite(least), least - slack, -np.inf)[:, None]) & (s > -np.inf))
        exact = np.concatenate([(own[row[c : c + 65536]] * X[col[c : c + 65536]]).sum(axis=1) for c in range(0, len(row), 65536)] or [np.zeros(0)])
        order = np.lexsort((key[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ok = rank < k
        out.append((ids[row[ok]], key[col[ok]], exact[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(rows: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows query_id long, rank int (from 1), key long, score double for each row for which queries holds."""
    own = rows.select(rows[key].cast("long").alias("key"), rows[vector].alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("key").isNotNull() & usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = f"query_id long, rank int, {key} long, score double"
    if not sizes or sizes[0].n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    own = own.where(F.size("v") == sizes[0].d)
    n = sizes[0].n
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, 2 ** round(np.log2(max(1, n / PART_ROWS))))))
    size = max(LEAST_SAMPLE, SAMPLE_A_PART * parts)
    sample = own.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(size + CALIBRATION).select("key", "v").toArrow()
    fitted = max(1, min(size, len(sample) - min(CALIBRATION, len(sample) // 8)))  # the others calibrate
    X = matrix(sample.column(1), np.float32)[:fitted]
    router = learn(X, min(parts, 2 ** int(np.log2(len(X)))))
    held = rows.sparkSession.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = held.value.logits(matrix(batch.column(1), np.float32)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["key", "v", "asks", "part"])

    vectors = own.schema["v"].dataType.simpleString()
    routed = settled(own.mapInArrow(place, f"key long, v {vectors}, asks boolean, part int"), "ann-routed")
    rest = slice(fitted, None) if fitted < len(sample) else slice(None)
    router = calibrated(router, routed, sample.column(0).to_numpy()[rest], matrix(sample.column(1))[rest], k)
    sizes = np.zeros(len(router.b), np.int64)
    for r in routed.groupBy("part").count().collect():  # MOST_PARTS rows at most
        sizes[r["part"]] = r["count"]
    told = rows.sparkSession.sparkContext.broadcast((router, sizes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, sizes = told.value
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-router.logits(matrix(batch.column(1), np.float32)), axis=1, kind="stable").astype(np.int32)
                enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1  # parts with k rows besides the query's own
                probes = [parts[:n] for parts, n in zip(order, np.maximum(enough, router.probes), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.list_(pa.int32()))], ["key", "v", "probes"])

    asked = routed.where("asks").select("key", "v").mapInArrow(ask, f"key long, v {vectors}, probes array<int>")
    asked = settled(asked.select("key", "v", F.explode("probes").alias("part")), "ann-asked")
    found = settled(ranked(routed, asked, k), "ann-found")
    # rows that share the query's key are its own, so where keys repeat even those parts can hold too few
    few = settled(found.groupBy("query_id").count().where(F.col("count") < k).select(F.col("query_id").alias("key")), "ann-few") if n > k + 1 else None
    if few is not None and not few.isEmpty():
        again = routed.where("asks").join(few, "key", "left_semi").select("key", "v", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("part"))
        more = ranked(routed, settled(again, "ann-again"), k)
        found = found.join(few.withColumnRenamed("key", "query_id"), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def ranked(routed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, key, score, rank: the k nearest rows of routed (key, v, part) in the parts that asked (key, v, part) names."""
    cells = lambda frame, name: frame.groupBy("part").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    cut = F.broadcast(settled(cells(routed, "cells").join(cells(asked, "cells_q"), "part"), "ann-cells"))  # MOST_PARTS rows at most
    cell = lambda i, j: F.xxhash64("part", i, j)
    of = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(cut, "part").select("key", "v", "part", of(17, F.col("cells")).alias("i"), every("cells_q").alias("j")).select(cell("i", "j").alias("cell"), "key", "v")
    right = asked.join(cut, "part").select("key", "v", "part", of(19, F.col("cells_q")).alias("j"), every("cells").alias("i")).select(cell("i", "j").alias("cell"), "key", "v")

    def rank(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(index) or not len(asked):
            return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x, s = best_of(asked["key"].to_numpy(), matrix(asked["v"]), index["key"].to_numpy(), matrix(index["v"]), k)
        return pa.table({"query_id": q, "key": x, "score": s})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(rank, "query_id long, key long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
