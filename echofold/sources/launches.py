"""Launch files: a JSON array or NDJSON, checked row by row with counted reasons. All built-in: rows are VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.parse import BASE58, trimmed
from echofold.sources.store import settled

#: Reasons in the order in which they are looked for.
REASONS = ["not-an-object", "bad-mint", "duplicate-in-file"]


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _member(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "variant")


def _text(name: str) -> Column:
    return F.when(_kind(_member(name)) == "STRING", F.try_variant_get("v", f"$.{name}", "string")).otherwise("")


def json_rows(lines: DataFrame, value: str = "value", order: str = "pos") -> DataFrame:
    """pos and v (VARIANT, null where a line does not parse) of NDJSON lines; blank lines are passed over."""
    text = trimmed(F.col(value))
    return lines.where(text != "").select(F.col(order).alias("pos"), F.try_parse_json(text).alias("v"))


def array_rows(texts: DataFrame, value: str = "value") -> DataFrame:
    """pos and v of the members of whole texts that are JSON arrays; anything else has no rows."""
    return texts.select(F.try_parse_json(F.col(value)).alias("a")).where(_kind(F.col("a")).startswith("ARRAY")).lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("a").outer())).select(F.col("pos").cast("long").alias("pos"), F.col("value").alias("v"))


def read_launches(spark: SparkSession, path: str) -> DataFrame:
    """Checked rows of a file. An array is one value, so it is read whole; NDJSON is read by line, in parallel."""
    head = spark.read.text(path, lineSep="\n").where(trimmed(F.col("value")) != "").limit(1).collect()
    if head and head[0][0].lstrip("﻿ \t\r\n").startswith("["):
        return checked(array_rows(spark.read.text(path, wholetext=True)))
    return checked(json_rows(spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())))


def checked(rows: DataFrame) -> DataFrame:
    """pos, the columns of LAUNCH, and reason (null: accepted). Members of a wrong type are empty, observedAt null unless positive."""
    kind = _kind(F.col("v"))
    number = _kind(_member("observedAt")).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    at = F.when(number, F.try_variant_get("v", "$.observedAt", "double"))
    own = rows.select("pos", kind.rlike("^(OBJECT|ARRAY)").alias("_object"), trimmed(_text("mint")).alias("mint"), *[_text(c).alias(c) for c in ("name", "symbol", "uri")], F.when((at > 0) & (at < float("inf")), at).alias("observedAt"))
    own = own.withColumn("reason", F.when(~F.col("_object"), REASONS[0]).when(~F.col("mint").rlike(BASE58), REASONS[1])).drop("_object")
    own = settled(own, "launches")  # rows are parsed once, though they are read twice
    bad, good = own.where("reason IS NOT NULL"), own.where("reason IS NULL")  # bad rows pass by: their mints are few, and all of one would go to one task
    first = good.groupBy("mint").agg(F.min("pos").alias("_first"))
    good = good.join(first, "mint").withColumn("reason", F.when(F.col("pos") != F.col("_first"), REASONS[2])).drop("_first")
    return good.unionByName(bad)


def report(rows: DataFrame) -> DataFrame:
    """One row: accepted, rejected, and a count of each reason."""
    return rows.agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), *[F.count_if(F.col("reason") == r).alias(r.replace("-", "_")) for r in REASONS])


def merged_reports(reports: DataFrame) -> DataFrame:
    return reports.agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", *(r.replace("-", "_") for r in REASONS))])


def as_observations(rows: DataFrame, now: int) -> DataFrame:
    """Accepted launches as sightings of source imported, without readings; seq is their place in the file."""
    null = lambda kind: F.lit(None).cast(kind)
    return rows.where("reason IS NULL").select(
        "mint", F.nullif("name", F.lit("")).alias("name"), F.nullif("symbol", F.lit("")).alias("symbol"), null("string").alias("imageUrl"), F.nullif("uri", F.lit("")).alias("metadataUri"),
        null("double").alias("marketCapUsd"), null("double").alias("volumeUsd"), null("double").alias("ageSeconds"), F.lit(now).cast("long").alias("seenAt"), F.lit("imported").alias("source"), F.col("pos").alias("seq"), "observedAt",
    )


def import_batch(rows: DataFrame, now: int) -> DataFrame:
    """Accepted launches folded to one row a mint; firstSeen goes back to observedAt where that is known."""
    from echofold.operators.merge import folded

    seen = as_observations(rows, now)
    at = seen.groupBy("mint").agg(F.min("observedAt").cast("long").alias("_at"))
    return folded(seen).join(at, "mint").withColumn("firstSeen", F.least("firstSeen", "_at")).drop("_at")


def imported(stored: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """stored records with accepted launches merged in."""
    from echofold.operators.merge import upsert

    return upsert(stored, import_batch(rows, now))
