"""Lookup: prior records of each subject by text or image, counted, ranked and held back while the corpus is young."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.images import hamming, images_match
from echofold.functions.similarity import best, pair_scores, recognised
from echofold.functions.text import with_norms
from echofold.model import THRESHOLDS, Thresholds
from echofold.operators.candidates import candidates
from echofold.operators.merge import ran_evidence
from echofold.sources.store import settled


def corpus_age(started_at: Column, now: Column) -> Column:
    return F.when(started_at == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), now - started_at))


def is_confident(age: Column, thresholds: Thresholds = THRESHOLDS) -> Column:
    return age >= thresholds.min_age_ms


def subjects_of(rows: DataFrame, coins: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """Subjects (mint, name, symbol) with their norms and a hash: the one stored under their own key, unless rows bring
    a column phash. A hash so given holds, a null too (no image); where rows also have a column phashGiven, only where
    that is true."""
    given = [c for c in ("phash", "phashGiven") if c in rows.columns]
    own = with_norms(rows.select("mint", "name", "symbol", *[F.col(c).alias(f"_{c}") for c in given]), thresholds)
    own = own.join(coins.select("mint", "phash"), "mint", "left")
    if "phash" in given:
        told = F.coalesce("_phashGiven", F.lit(False)) if "phashGiven" in given else F.lit(True)
        own = own.withColumn("phash", F.when(told, F.col("_phash")).otherwise(F.col("phash")))
    return own.drop("_phash", "_phashGiven")


def on_cards(found: DataFrame, cards: DataFrame, order: str = "pos") -> DataFrame:
    """found (mint, ...) joined to the cards now shown: of several cards of a mint the last; mints without one are left out.

    Cards are reduced to one a mint before the shuffle, so a mint that is shown often is a row a task.
    """
    rest = [c for c in cards.columns if c != "mint"]
    last = cards.groupBy("mint").agg(F.max_by(F.struct(*rest), order).alias("card"))
    return found.join(last, "mint")


def priors(subjects: DataFrame, coins: DataFrame, thresholds: Thresholds = THRESHOLDS, found: DataFrame | None = None) -> DataFrame:
    """A row for each subject and prior record, with its rank.

    Kept: text at the strict bar, or an image within the distance. matchedOn is what the strict bar recognised, else what
    the looser bar did, then image. Both bars come from one score of each field pair. found: candidates() of the same.
    """
    found = (candidates(subjects, coins, thresholds) if found is None else found).select("subject", "capped", F.explode("mints").alias("mint"))
    s = subjects.select(F.col("mint").alias("subject"), F.col("normName").alias("_name"), F.col("normSymbol").alias("_symbol"), F.col("phash").alias("_phash"))
    rows = found.join(coins, "mint").join(s, "subject")
    rows = rows.withColumn("_scores", pair_scores(F.col("normName"), F.col("normSymbol"), F.col("_name"), F.col("_symbol"), thresholds.narrative.min_length))
    rows = rows.withColumn("imageDistance", hamming(F.col("_phash"), F.col("phash")))
    image, text = images_match(F.col("imageDistance"), thresholds), best(F.col("_scores"), thresholds.narrative.min_similarity)
    strict, loose = (recognised(F.col("_scores"), t.min_similarity) for t in (thresholds.narrative, thresholds.with_image))
    matched = F.concat(F.when(F.size(strict) > 0, strict).otherwise(loose), F.when(image, F.array(F.lit("image"))).otherwise(F.array().cast("array<string>")))
    score = F.greatest(F.coalesce(text, F.lit(0.0)), F.when(image, 1 - F.col("imageDistance") / 64).otherwise(0.0))
    rows = rows.where(text.isNotNull() | image).withColumns({"similarity": score, "matchedOn": matched, "evidence": ran_evidence(F.col("peakMcUsd"), F.col("sawMigrated"), thresholds)})
    order = Window.partitionBy("subject").orderBy(F.desc("similarity"), F.collate("mint", "UNICODE"))  # at most max_candidates rows each
    return rows.withColumn("rank", F.row_number().over(order)).select("subject", "rank", "mint", "name", "symbol", "imageUrl", "firstSeen", "lastSeen", "peakMcUsd", "ran", "evidence", "similarity", "matchedOn", "imageDistance", "capped")


def lookup(subjects: DataFrame, coins: DataFrame, started_at: int, now: int, thresholds: Thresholds = THRESHOLDS, found: DataFrame | None = None) -> DataFrame:
    """One row per subject: ranCount, totalCount, capped, confident, corpusAgeMs. found: candidates() of the same."""
    found = settled(candidates(subjects, coins, thresholds), "candidates") if found is None else found
    counts = priors(subjects, coins, thresholds, found).groupBy("subject").agg(F.count_if("ran").alias("ranCount"), F.count("*").alias("totalCount"))
    age = corpus_age(F.lit(started_at).cast("long"), F.lit(now).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return subjects.select(F.col("mint").alias("subject")).join(counts, "subject", "left").join(found.select("subject", "capped"), "subject", "left").select(
        F.col("subject").alias("mint"), zero("ranCount"), zero("totalCount"), F.coalesce("capped", F.lit(False)).alias("capped"), is_confident(age, thresholds).alias("confident"), age.alias("corpusAgeMs")
    )


def popover(found: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """The rows that a popover shows: those that ran first, then by peak (no reading as 0), then as ranked; popover_rows at most."""
    order = Window.partitionBy("subject").orderBy(F.desc("ran"), F.desc(F.coalesce("peakMcUsd", F.lit(0.0))), "rank")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= thresholds.popover_rows)
