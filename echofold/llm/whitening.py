"""Embedding whitening by a tall, thin QR: no covariance of the embeddings is ever formed.

A component c counts as the whole number floor(64 c) + 1,000,000. The fit list is each distinct row of such numbers once: rows
are packed into as few bytes as their numbers need and made distinct by Spark, which drops repeats before its shuffle, so a
vector that a third of all rows share is a row a task. Whole sums over the list centre it exactly. Each task then folds its
centred rows into one triangular factor R, batch by batch; FAN_IN factors at a time are stacked and factored again, level by
level, until one is left, whose singular values and right vectors are those of the whole list. A last pass over the table
projects its rows. A factor is size x size, whatever the number of rows.

Defined results: rows whose vector is null, empty or of another size than most, or holds a null or non-finite component, are
dropped; repeated rows repeat their results; null keys stay. A component whose spread is zero (fewer distinct vectors than
components, or components that never change) has whitened null and explained 0, and identity_error leaves it out (0 where none
is left). A deviation past a long is null. Numbers so large that rows cannot be centred exactly raise ArithmeticError. An empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.ann import matrix
from echofold.llm.batches import utf8_view
from echofold.llm.storage import settled
from echofold.llm.vectors import finite, main_size

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FAN_IN = 8
AT_ONCE = 4096


@dataclass
class Whitening:
    """n rows of the fit list, their whole sums, the components as columns, and the eigenvalues and the trace of the covariance."""

    size: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def rest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums in two whole parts, a and b, as n * a - b: a is x less the rounded means, b what they were rounded by."""
        mean = np.array([s // self.n for s in self.sums], np.int64)
        return x - mean, np.array([s - self.n * (s // self.n) for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        a, b = self.rest(x)
        return a - b / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A row's components, NaN where the spread is zero."""
        scale = np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.nan))
        return self.centred(x) @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> np.ma.MaskedArray:
        """The squares of n * x - sums, summed; masked where that is past a long."""
        a, b = self.rest(x)
        near = (np.abs(a).astype(float) + 1) * self.n
        past = (near * near).sum(axis=1) >= 2.0**62
        out = np.zeros(len(x), np.int64)
        y = self.n * a[~past] - b
        out[~past] = (y * y).sum(axis=1)
        for k in np.flatnonzero(past):  # near the limit: in numbers without one
            exact = sum((self.n * int(p) - int(q)) ** 2 for p, q in zip(a[k], b, strict=True))
            past[k] = exact >= 2**63
            out[k] = 0 if past[k] else exact
        return np.ma.array(out, mask=past)


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64) + SHIFT


def packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes: each in the narrowest of three widths that holds its numbers less SHIFT, so equal rows are equal bytes."""
    x = x - SHIFT
    most = np.abs(x).max(axis=1)
    out: list[bytes] = [b""] * len(x)
    for rows, kind in ((most < 2**15, "<i2"), ((most >= 2**15) & (most < 2**31), "<i4"), (most >= 2**31, "<i8")):
        for k, row in zip(np.flatnonzero(rows), x[rows].astype(kind), strict=True):
            out[k] = row.tobytes()
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    raw, offs = utf8_view(column)
    width = np.diff(offs) // size
    out = np.zeros((len(width), size), np.int64)
    for bytes_, kind in ((2, "<i2"), (4, "<i4"), (8, "<i8")):
        rows = np.flatnonzero(width == bytes_)
        if len(rows):
            own = raw if len(rows) == len(width) else np.concatenate([raw[offs[k] : offs[k + 1]] for k in rows])
            out[rows] = np.frombuffer(own.tobytes(), kind).reshape(len(rows), size)
    return out + SHIFT


def triangle(blocks: list[np.ndarray], size: int) -> np.ndarray:
    """The factor R of stacked blocks, size x size; fewer rows are filled up with zeros."""
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return np.pad(r, ((0, size - len(r)), (0, 0)))


def factor(rows: DataFrame, centred, size: int) -> np.ndarray | None:
    """R of all centred rows of a column x of packed rows: one factor a task, merged FAN_IN at a time. None without rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                block = centred(unpacked(batch.column(0).slice(k, AT_ONCE), size))
                held = triangle([block] if held is None else [held, block], size)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["node", "r"])

    def merge(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        blocks = [np.frombuffer(r, np.float64).reshape(size, size) for r in nodes["r"].to_pylist()]
        return pa.table({"node": pa.array([nodes["node"][0].as_py() // FAN_IN], pa.int64()), "r": pa.array([triangle(blocks, size).tobytes()], pa.binary())})

    nodes, count = rows.select("x").mapInArrow(fold, "node long, r binary"), rows.rdd.getNumPartitions()
    while count > 1:
        nodes, count = nodes.groupBy(F.floor(F.col("node") / FAN_IN)).applyInArrow(merge, "node long, r binary"), -(-count // FAN_IN)
    found = nodes.collect()  # one
    return np.frombuffer(found[0].r, np.float64).reshape(size, size) if found else None


def fit_list(own: DataFrame) -> DataFrame:
    """x: the distinct rows of whole numbers of a column v, packed, in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([packed(whole(matrix(batch.column(0))))], ["x"])

    return settled(own.select("v").mapInArrow(pack, "x binary").distinct(), "fit-list")


def totals(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows and their sums, whole: those less SHIFT are added by task, then by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + (unpacked(batch.column(0), size) - SHIFT).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(total)], ["at", "n", "total"])

    sums = fit.mapInArrow(add, "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect()
    sums.sort(key=lambda r: r["at"])
    n = sums[0]["n"] if sums else 0
    return n, [int(r["total"]) + n * SHIFT for r in sums]


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """key and v of the rows that take part, and the vectors' size."""
    own = rows.select(rows[key].alias("key"), rows[vector].alias("v")).where(finite(F.col("v")))
    size, count, largest = main_size(own, "v")
    if size and max(1, count) * (SCALE * largest + 1) >= 2**62:
        raise ArithmeticError(f"components of up to {largest} in {count} rows cannot be centred exactly")
    return own.where(F.size("v") == size), size


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's distinct rows; None for a table without any."""
    own, size = usable(rows, key, vector)
    if not size:
        return None
    distinct = fit_list(own)
    n, sums = totals(distinct, size)
    bare = Whitening(size, n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    r = factor(distinct, bare.centred, size)
    _, spread, right = np.linalg.svd(r)
    eigenvalues = spread * spread / n
    trace = float(eigenvalues.sum())
    eigenvalues[spread <= spread[0] * max(n, size) * np.finfo(float).eps] = 0.0
    model = Whitening(size, n, sums, right[:components].T.copy(), eigenvalues[:components], trace)
    model.identity_error = identity_error(distinct, model)
    return model


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the whitened fit list's covariance less the identity."""
    live = np.flatnonzero(model.eigenvalues > 0)
    k = len(live)
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(unpacked(batch.column(0), model.size))[:, live]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "total"])

    sums = distinct.mapInArrow(products, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()  # components squared
    covariance = np.zeros(k * k)
    for r in sums:
        covariance[r["at"]] = r["total"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component int (from 1), n, deviation, whitened, explained, identity_error, for each row that takes part and component."""
    own = rows.select(rows[key].alias("key"), rows[vector].alias("v"))
    schema = f"key {own.schema['key'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.eigenvalues)
        share = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(k)
        names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                x = whole(matrix(part.column(1)))
                n = len(x)
                told, each = model.whitened(x).ravel(), np.repeat(np.arange(n), k)
                far = model.deviation(x)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), pa.array(far.data[each], mask=np.ma.getmaskarray(far)[each]),
                    pa.array(told, mask=np.isnan(told)), pa.array(np.tile(share, n)), pa.array(np.full(n * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    found = own.where(finite(F.col("v")) & (F.size("v") == model.size)).mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)
