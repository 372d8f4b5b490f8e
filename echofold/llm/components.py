"""Connected components of a link table, by alternating large-star and small-star steps over Spark.

Each round settles its links in the shared folder, so lineage stays short and a lost executor costs one round at most.
Before a round, each partition replaces its links by a spanning forest, so hubs and repeated links shrink early. Once
ONE_TASK links or fewer are left, which is some megabytes at most, one task ends the work.

Defined results: a link with a null end is no link, nor is a loop; repeated links count once; no links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.storage import settled

FOREST_LINKS = 1 << 20
ONE_TASK = 1 << 17


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, where root[x] names x's component by its smallest member, after links i-j."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for all other members of each component of links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = hook(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FOREST_LINKS:
            held = [out(held)]
            size = held[0].num_rows
            if size >= FOREST_LINKS // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield out(held)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node long, component long (its smallest node) for every node of links (a long, b long); a loop a = b is no link."""
    links = settled(links.where("a <> b").mapInArrow(_local, "a long, b long").distinct(), "links")
    if links.count() <= ONE_TASK:
        return _with_roots(links.repartition(1).mapInArrow(_local, "a long, b long"))
    state = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        links = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = settled(links, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _with_roots(links)


def _with_roots(links: DataFrame) -> DataFrame:
    """node, component of links (member, smallest member), which the smallest members' own rows are added to."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
