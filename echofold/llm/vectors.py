"""Which vectors of a column take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Neither null nor empty, and no component null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def main_size(rows: DataFrame, vector: str) -> tuple[int, int, float]:
    """The size that most vectors have (of several the smallest), how many have it, and their largest component without its
    sign; zeros for an empty table."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"), F.max(largest).alias("largest"))
    found = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    return (found[0].d, found[0].n, found[0].largest) if found else (0, 0, 0.0)
