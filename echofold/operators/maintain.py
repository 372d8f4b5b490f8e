"""Upkeep of the record table: retention, image work, hash verdicts, meta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.model import THRESHOLDS, Thresholds


def stale(thresholds: Thresholds, now: int):
    return (F.col("lastSeen") < now - thresholds.retention_ms) & ~F.col("ran")


def retained(coins: DataFrame, now: int, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """Without the records that never ran and were last seen before the cutoff."""
    return coins.where(~stale(thresholds, now))


def removed_count(coins: DataFrame, now: int, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    return coins.agg(F.count_if(stale(thresholds, now)).alias("removed"), F.count_if(~stale(thresholds, now)).alias("kept"))


def pending_images(coins: DataFrame, mints: DataFrame, now: int, thresholds: Thresholds = THRESHOLDS, attempted_at: str = "lastSeen") -> DataFrame:
    """mint, imageUrl to hash, of the mints asked for: no verdict yet, or unavailable and last tried retry_ms ago or more."""
    waiting = (F.col("phashState") == "unavailable") & (now - F.col(attempted_at) < thresholds.retry_ms)
    due = F.col("imageUrl").isNotNull() & F.col("phash").isNull() & F.coalesce(F.col("phashState") != "degenerate", F.lit(True)) & ~F.coalesce(waiting, F.lit(False))
    return coins.where(due).join(mints.select("mint").distinct(), "mint", "left_semi").select("mint", "imageUrl")


def with_hashes(coins: DataFrame, verdicts: DataFrame) -> DataFrame:
    """coins with verdicts (mint, phash, state) written over; verdicts of unknown mints create nothing."""
    v = verdicts.select(F.col("mint").alias("_m"), F.col("phash").alias("_h"), F.col("state").alias("_s"))
    rows = coins.join(v, coins.mint == v._m, "left")
    told = F.col("_m").isNotNull()
    return rows.withColumns({"phash": F.when(told, F.col("_h")).otherwise(F.col("phash")), "phashState": F.when(told, F.col("_s")).otherwise(F.col("phashState"))}).select(*coins.columns)


def hashes_written(coins: DataFrame, verdicts: DataFrame) -> DataFrame:
    return verdicts.join(coins.select("mint"), "mint", "left_semi").agg(F.count("*").alias("written"))


def meta(coins: DataFrame, started_at: int | None = None) -> DataFrame:
    """One row: startedAt (0 where nothing was ever written), schemaVersion, coinCount."""
    start = F.coalesce(F.lit(started_at).cast("long"), F.min("firstSeen"), F.lit(0).cast("long"))
    return coins.agg(start.alias("startedAt"), F.lit(1).alias("schemaVersion"), F.count("*").alias("coinCount"))


def in_order(coins: DataFrame, mints: DataFrame) -> DataFrame:
    """The records of a list of keys (mints: pos, mint), in its order; unknown keys are left out, repeated ones repeat."""
    return mints.join(coins, "mint").orderBy("pos")
