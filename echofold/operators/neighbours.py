"""All pairs of hashes within a number of bits, whatever their number.

Of four bands of 16 bits, one differs in a quarter of the bits at most. So each hash stands in an index under its four bands,
and asks under all values that near to each of its own (137 a band at ten bits), enumerated by masks. A pair is taken where its
first such band meets, which is once. Equal hashes are one in the join: pairs are between different hashes, with their numbers
of rows, so no group of copies is expanded.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions.images import hamming
from echofold.model import THRESHOLDS
from echofold.sources.store import settled

BANDS, WIDTH = 4, 16


def band_values(phash: Column) -> Column:
    """A hash's bands as numbers; null for anything but 16 hex digits."""
    digits = WIDTH // 4
    parts = F.array(*[F.conv(F.lower(phash).substr(digits * k + 1, digits), 16, 10).cast("int") for k in range(BANDS)])
    return F.when(phash.rlike("^[0-9a-fA-F]{16}$"), parts)


def near_hashes(rows: DataFrame, phash: str = "phash", most: int = THRESHOLDS.max_hamming) -> tuple[DataFrame, DataFrame]:
    """(hash, n: rows of it) and (a, b, distance) of all pairs of different hashes at most so many bits apart, a before b."""
    known = settled(rows.select(F.lower(rows[phash]).alias("hash"), band_values(rows[phash]).alias("bands")).where("bands IS NOT NULL").groupBy("hash").agg(F.first("bands").alias("bands"), F.count("*").alias("n")), "hashes")
    radius = most // BANDS
    masks = F.array(*[F.lit(sum(1 << k for k in bits)) for n in range(radius + 1) for bits in combinations(range(WIDTH), n)])
    near = lambda v: F.transform(masks, lambda m: v.bitwiseXOR(m))
    index = known.select(F.posexplode("bands").alias("band", "value"), F.col("hash").alias("b"), F.col("bands").alias("other"))
    asks = known.select(F.posexplode("bands").alias("band", "own"), F.col("hash").alias("a"), "bands").select("band", F.explode(near(F.col("own"))).alias("value"), "a", "bands")
    differs = lambda k: F.bit_count(F.get("bands", k).bitwiseXOR(F.get("other", k)))
    earlier = F.exists(F.sequence(F.lit(0), F.col("band") - 1), lambda k: differs(k) <= radius)
    found = asks.join(index, ["band", "value"]).where((F.col("a") < F.col("b")) & ((F.col("band") == 0) | ~earlier))
    return known.select("hash", "n"), found.select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance") <= most)
