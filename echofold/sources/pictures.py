"""Pictures as hash verdicts: PNG files or raw RGBA planes; those too large or unreadable are told apart from flat ones."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import png
from echofold.functions.images import hash_pixels
from echofold.model import THRESHOLDS, Thresholds


def sampled(contents: list[bytes | None], size: int = THRESHOLDS.sample_size) -> list[bytes | None]:
    """The size x size RGBA bytes of PNG files; other bytes as they are; null for a PNG that can't be read."""
    files = [k for k, x in enumerate(contents) if x is not None and x.startswith(png.SIGNATURE)]
    out = list(contents)
    for k in files:
        out[k] = None
    for places, pixels in png.stacks(contents[k] for k in files):
        for k, own in zip(places, png.shrunk(pixels, size), strict=True):
            out[files[k]] = own.tobytes()
    return out


def verdicts_of(rows: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """mint, phash, state (ok, degenerate, unavailable) of rows mint, content. Contents over max_image_bytes are not read."""
    content = F.when(F.octet_length("content") <= thresholds.max_image_bytes, F.col("content"))
    found = rows.select("mint", hash_pixels(content, thresholds, partial(sampled, size=thresholds.sample_size)).alias("r"))
    return found.select("mint", F.col("r.hash").alias("phash"), F.coalesce("r.failure", F.lit("ok")).alias("state"))


def verdicts(spark: SparkSession, path: str, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """verdicts_of() the files below a path, named by their stems. Files over max_image_bytes are never loaded."""
    rows = spark.read.format("binaryFile").load(path)
    small = rows.where(F.col("length") <= thresholds.max_image_bytes).select("path", "content")
    large = rows.where(F.col("length") > thresholds.max_image_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return verdicts_of(small.union(large).select(stem.alias("mint"), "content"), thresholds)
