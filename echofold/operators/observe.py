"""Raw rows to observations, with reject reasons, one row a key, extraction rates and their diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions import parse
from echofold.functions.text import clean_text
from echofold.model import THRESHOLDS, TRACKED, Thresholds

NO_MINT, MISMATCH = "no-mint", "mint-mismatch"


def judged(raw: DataFrame, base: str = "https://example.invalid/") -> DataFrame:
    """raw (RAW_ROW and source, seenAt) with the observation's columns and rejected: a reason, or null where the row is kept."""
    names = raw.columns
    raw, mint = raw.withColumn("_mint", parse.mint_from_href(F.col("mintHref"))), F.col("_mint")
    reason = F.when(mint.isNull(), NO_MINT).when(~parse.truncated_matches(F.col("mintText"), mint), MISMATCH)
    own = [mint.alias("mint"), *(clean_text(F.col(c)).alias(c) for c in ("name", "symbol")), parse.clean_image_url(F.col("imageUrl"), base).alias("imageUrl"), clean_text(F.col("metadataUri")).alias("metadataUri"), parse.compact_number(F.col("marketCap")).alias("marketCapUsd"), parse.compact_number(F.col("volume")).alias("volumeUsd"), parse.age_seconds(F.col("age")).alias("ageSeconds")]
    rest = [c for c in names if c not in ("mintHref", "mintText", "name", "symbol", "imageUrl", "metadataUri", "marketCap", "volume", "age")]
    return raw.select(*rest, *own, reason.alias("rejected"))


def observations(rows: DataFrame) -> DataFrame:
    return rows.where("rejected IS NULL").drop("rejected")


def completeness(fields: list[str] = TRACKED) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))


def dedupe_by_mint(rows: DataFrame, order: str = "pos") -> DataFrame:
    """The most complete row of each mint (ties: the earlier), with first, the place where the mint first stood.

    Only an aggregate: rows of one mint are reduced before the shuffle, so a hot mint is a row a task.
    """
    whole = F.struct(*rows.columns)
    best = rows.groupBy("mint").agg(F.max_by(whole, F.struct(completeness(), -F.col(order))).alias("row"), F.min(order).alias("first"))
    return best.select("row.*", "first")


def tally(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows, kept, a count for each reject reason, and each tracked field's share of kept rows (0 if none is kept)."""
    kept = F.count_if(F.col("rejected").isNull())
    rate = lambda c: F.when(kept == 0, 0.0).otherwise(F.count_if(F.col("rejected").isNull() & F.col(c).isNotNull()) / kept).alias(f"rate_{c}")
    aggs = [F.count("*").alias("rows"), kept.alias("kept"), F.count_if(F.col("rejected") == NO_MINT).alias("no_mint"), F.count_if(F.col("rejected") == MISMATCH).alias("mint_mismatch"), *map(rate, TRACKED)]
    return rows.groupBy(*(by or [])).agg(*aggs)


def diagnose(report: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """report with health (cold, mints-failing, fields-failing, ok) and failing (fields under the floor; metadataUri isn't judged)."""
    low = F.array_compact(F.array(*[F.when(F.col(f"rate_{c}") < thresholds.floor, F.lit(c)) for c in TRACKED if c != "metadataUri"]))
    health = F.when(F.col("rows") < thresholds.min_rows, "cold").when(F.col("kept") == 0, "mints-failing").when(F.size(low) > 0, "fields-failing").otherwise("ok")
    return report.withColumn("health", health).withColumn("failing", F.when(F.col("health") == "fields-failing", low).otherwise(F.array().cast("array<string>")))
