"""Sightings folded into one record per key, and records classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions.text import normalize, text_trigrams, with_norms
from echofold.model import THRESHOLDS, Thresholds

#: Fixed value: the only source that shows a key has migrated.
MIGRATED = "migrated"


def is_migrated(source: Column) -> Column:
    return F.coalesce(source == MIGRATED, F.lit(False))


def did_run(peak: Column, migrated: Column, thresholds: Thresholds = THRESHOLDS) -> Column:
    """Seen migrated, or a peak at or over the floor; no reading is no run."""
    return migrated | F.coalesce(peak >= thresholds.min_peak_usd, F.lit(False))


def ran_evidence(peak: Column, migrated: Column, thresholds: Thresholds = THRESHOLDS) -> Column:
    return F.when(migrated, "migrated").when(peak >= thresholds.min_peak_usd, "market-cap").otherwise("none")


def folded(observations: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per mint, partly aggregated before the shuffle: first non-null texts in order of seq, extremes, latch, count."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    return observations.groupBy("mint").agg(
        first("name"), first("symbol"), first("imageUrl"), F.min("seenAt").alias("firstSeen"), F.max("seenAt").alias("lastSeen"), F.max("marketCapUsd").alias("peakMcUsd"), F.max("volumeUsd").alias("peakVolUsd"),
        F.bool_or(is_migrated(F.col("source"))).alias("sawMigrated"), F.count("*").alias("sightings"),
    )


def finished(rows: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds norms, trigrams of the stored text, and ran, which so never lags its thresholds."""
    return with_norms(rows, thresholds).withColumn("ran", did_run(F.col("peakMcUsd"), F.col("sawMigrated"), thresholds))


def fold(observations: DataFrame, thresholds: Thresholds = THRESHOLDS, seq: str = "seq") -> DataFrame:
    """COIN rows of a first batch."""
    rows = finished(folded(observations, seq), thresholds)
    return rows.withColumns({"phash": F.lit(None).cast("string"), "phashState": F.lit(None).cast("string")})


def arrival_trigrams(observations: DataFrame, thresholds: Thresholds = THRESHOLDS, seq: str = "seq") -> DataFrame:
    """mint and the trigrams that a store keeping those of the last gap-filling row would hold: of the row where the later
    of the first name and the first symbol came, else of the first row."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col(seq)))
    at = observations.groupBy("mint").agg(F.coalesce(F.greatest(first("name"), first("symbol")), F.min(seq)).alias("_at"))
    at = at.withColumnRenamed("mint", "_mint")
    rows = observations.join(at, (F.col("mint") == F.col("_mint")) & (F.col(seq) == F.col("_at"))).select("mint", "name", "symbol")
    return with_norms(rows, thresholds).select("mint", "trigrams")


def upsert(stored: DataFrame, batch: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """stored COIN rows with a batch of folded rows merged in: texts fill gaps only, peaks and latches never fall."""
    s, b = stored.alias("s"), batch.alias("b")
    both = s.join(b, "mint", "full_outer")
    keep = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"b.{c}")).alias(c)
    rows = both.select(
        "mint", keep("name"), keep("symbol"), keep("imageUrl"), F.col("s.phash").alias("phash"), F.col("s.phashState").alias("phashState"),
        F.least("s.firstSeen", "b.firstSeen").alias("firstSeen"), F.greatest("s.lastSeen", "b.lastSeen").alias("lastSeen"), F.greatest("s.peakMcUsd", "b.peakMcUsd").alias("peakMcUsd"), F.greatest("s.peakVolUsd", "b.peakVolUsd").alias("peakVolUsd"),
        (F.coalesce("s.sawMigrated", F.lit(False)) | F.coalesce("b.sawMigrated", F.lit(False))).alias("sawMigrated"), (F.coalesce("s.sightings", F.lit(0)) + F.coalesce("b.sightings", F.lit(0))).alias("sightings"),
    )
    return finished(rows, thresholds)


def told_once(rows: DataFrame) -> DataFrame:
    """COIN_TOLD rows with _seq, one a mint: texts as first told, extremes, latch, count, the last verdict on its image."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col("hashed"), F.col("_seq"))).alias(c)
    return rows.groupBy("mint").agg(
        first("name"), first("symbol"), first("imageUrl"), F.min("firstSeen").alias("firstSeen"), F.max("lastSeen").alias("lastSeen"), F.max("peakMcUsd").alias("peakMcUsd"), F.max("peakVolUsd").alias("peakVolUsd"),
        F.bool_or("sawMigrated").alias("sawMigrated"), F.sum("sightings").alias("sightings"), F.bool_or("deleted").alias("deleted"), F.bool_or("hashed").alias("hashed"), last("phash"), last("phashState"),
    )


def with_told(stored: DataFrame, told: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """stored COIN rows with told_once() rows merged in: those removed go, and come back with sightings after that alone."""
    s, t = stored.withColumnRenamed("mint", "_stored").alias("s"), told.withColumnRenamed("mint", "_told").alias("t")
    gone, judged = F.coalesce("t.deleted", F.lit(False)), F.coalesce("t.hashed", F.lit(False))
    held = lambda c: F.when(~gone, F.col(f"s.{c}"))
    keep = lambda c: F.coalesce(held(c), F.col(f"t.{c}")).alias(c)
    came = lambda c: F.when(held(c).isNull(), F.col(f"t.{c}")).alias(f"_{c}")
    norm = lambda c: F.when(held(c) != "", F.col(f"s.{c}")).alias(c)
    verdict = lambda c: F.when(judged, F.col(f"t.{c}")).otherwise(held(c)).alias(c)
    least, most = (lambda c, f=f: f(held(c), F.col(f"t.{c}")).alias(c) for f in (F.least, F.greatest))
    rows = s.join(t, F.col("_stored") == F.col("_told"), "full_outer").where((F.col("_stored").isNotNull() & ~gone) | (F.col("t.sightings") > 0))
    merged = rows.select(
        F.coalesce("_stored", "_told").alias("mint"), keep("name"), keep("symbol"), came("name"), came("symbol"), norm("normName"), norm("normSymbol"), held("trigrams").alias("_trigrams"), keep("imageUrl"), verdict("phash"), verdict("phashState"),
        least("firstSeen"), most("lastSeen"), most("peakMcUsd"), most("peakVolUsd"),
        (F.coalesce(held("sawMigrated"), F.lit(False)) | F.coalesce("t.sawMigrated", F.lit(False))).alias("sawMigrated"), (F.coalesce(held("sightings"), F.lit(0)) + F.coalesce("t.sightings", F.lit(0))).alias("sightings"),
    )
    # only texts that came are normalized; of a record that kept both texts the trigrams stay
    for text, kept in (("name", "normName"), ("symbol", "normSymbol")):
        merged = merged.withColumn(kept, F.coalesce(kept, normalize(F.col(f"_{text}")), F.lit("")))
    grams = text_trigrams(F.col("normName"), F.col("normSymbol"), thresholds.trigram_min_length)
    same = F.col("_name").isNull() & F.col("_symbol").isNull() & F.col("_trigrams").isNotNull()
    merged = merged.withColumn("trigrams", F.when(same, F.col("_trigrams")).otherwise(grams)).drop("_name", "_symbol", "_trigrams")
    return merged.withColumn("ran", did_run(F.col("peakMcUsd"), F.col("sawMigrated"), thresholds))


def coin_trigrams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("trigrams", text_trigrams(F.col("normName"), F.col("normSymbol")))
