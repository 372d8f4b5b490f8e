"""The synthetic tables in the roles that the operators read: records, sightings, raw rows, launch lines, cards, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.functions import png
from echofold.functions.images import hash_coefficients
from echofold.functions.pieces import pieces
from echofold.functions.text import with_norms
from echofold.operators.merge import did_run

T0 = 1_758_300_000_000
NOW = T0 + 40 * 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Rows of a file of fewer parts than cores, dealt over all cores; larger inputs stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def address(number: Column) -> Column:
    """A number as a whole address: 36 characters of the alphabet."""
    return F.concat(F.lit("M"), F.translate(F.lpad(number.cast("string"), 35, "1"), "0", "z"))


def png_file(pixels: Column, number: Column, side: int = 32) -> Column:
    """side x side RGBA bytes as a PNG file; a number tells the filters of its rows, and whether it is twice the size."""

    def files(values: list[bytes], number: np.ndarray) -> pa.Array:
        out = np.empty(len(values), object)
        for times in (1, 2):
            places = np.flatnonzero(number % 2 == times - 1)
            for own in (places[k : k + 64] for k in range(0, len(places), 64)):
                picture = np.frombuffer(b"".join(values[k] for k in own), np.uint8).reshape(-1, side, side, 4)
                picture = picture.repeat(times, axis=1).repeat(times, axis=2)
                out[own] = png.encoded(picture, png.RGBA, (np.arange(side * times) + number[own, None]) % 5)
        return pa.array(out, pa.binary())

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array, numbers: pa.Array) -> pa.Array:
        number = pc.fill_null(numbers, 0).to_numpy(zero_copy_only=False)
        out = [files(values.slice(at, n).to_pylist(), number[at : at + n]) for at, n in pieces(values)]
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run(pixels, number)


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, phash: the first 64 coefficients of each embedding as a hash."""
    return table(spark, sf_dir, "embeddings").select("vec_id", hash_coefficients(F.slice("embedding", 1, 64)).alias("phash"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as COIN rows, whole columns each: name and brand are the name, type and size the symbol; hashes by number."""
    number = F.col("p_partkey")
    seen = T0 + number * 1000
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").select(
        number.cast("string").alias("mint"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("name"),
        F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("symbol"),
        F.lit(None).cast("string").alias("imageUrl"),
        seen.alias("firstSeen"),
        (seen + F.col("p_size") * 1000).alias("lastSeen"),
        (F.floor("p_retailprice") * 100.0).alias("peakMcUsd"),
        F.lit(None).cast("double").alias("peakVolUsd"),
        (number % 7 == 0).alias("sawMigrated"),
        F.lit(1).cast("long").alias("sightings"),
        number.alias("number"),
    )
    rows = with_norms(rows).withColumn("ran", did_run(F.col("peakMcUsd"), F.col("sawMigrated")))
    known = hashes(spark, sf_dir)
    return rows.join(known, rows.number == known.vec_id, "left").withColumn("phashState", F.when(F.col("phash").isNotNull(), "ok")).drop("vec_id")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with few names and many keys: buckets over the cap."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("mint"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("phash"), "p_partkey")
    return with_norms(rows)


def word(number: Column) -> Column:
    """Twelve letters that a third of a number tells (letters of its digest), and one that the rest tells."""
    return F.concat(F.translate(F.substring(F.md5(F.floor(number / 3).cast("string").cast("binary")), 1, 12), "0123456789", "ghijklmnop"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (number % 3 + 1).cast("int")))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of words: three have names with one letter apart, and nine of ten have the name of a later one as their symbol."""
    number = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(number.alias("number"), number.cast("string").alias("mint"), word(number).alias("name"), F.when(number % 50 < 45, word(number + 3)).alias("symbol"))
    return spread(with_norms(rows).select("mint", "normName", "normSymbol", "number"))


def sightings(rows: DataFrame) -> DataFrame:
    """Events as sightings, in an arrival order (seq) that is not that of time, with gaps in the texts."""
    kind = F.col("event_type")
    source = F.when(kind == "purchase", "migrated").when(kind == "signup", "new-pairs").when(kind == "click", "final-stretch").when(kind == "view", "trending").otherwise("other")
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    return rows.select(
        F.col("user_id").cast("string").alias("mint"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("The "), kind)).alias("name"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("S-"), F.col("event_id") % 10)).alias("symbol"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("https://img.example/"), F.col("event_id") % 7)).alias("imageUrl"), F.lit(None).cast("string").alias("metadataUri"), F.when(kind != "error", F.col("value") * 300).alias("marketCapUsd"), F.when(kind == "view", F.col("value")).alias("volumeUsd"), F.lit(None).cast("double").alias("ageSeconds"),
        F.floor(ms).cast("long").alias("seenAt"), source.alias("source"), (F.col("event_id") * 7919 % 1000003).alias("seq"), "event_id",
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw card rows, some without a key, some with a footer of another key, with figures and ages as text."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    mint = address(F.col("o_custkey"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")).select(
        F.when(k % 11 == 0, "/coin/list").otherwise(F.concat(F.lit("https://x.example/meme/"), mint, F.lit("?tab=1"))).alias("mintHref"),
        F.when(k % 13 == 0, "zz...zz").when(k % 3 == 0, F.concat(mint.substr(1, 4), F.lit("..."), mint.substr(33, 4))).alias("mintText"),
        F.when(k % 5 != 0, F.concat(F.lit("  Customer  "), F.col("o_custkey"), F.lit(" "))).alias("name"), F.when(k % 7 != 0, F.col("o_orderpriority")).otherwise(" ").alias("symbol"),
        F.when(k % 2 == 0, F.concat(F.lit("data:image/png;base64,"), k)).when(k % 4 == 1, F.concat(F.lit("/img/"), k, F.lit(".webp"))).alias("imageUrl"), F.lit(None).cast("string").alias("metadataUri"),
        F.when(k % 4 == 0, "—").when(k % 2 == 0, F.concat(F.lit("$"), F.floor(price / 1000), F.lit(".5K"))).otherwise(F.concat(F.lit("$"), F.format_number(price, 0))).alias("marketCap"),
        F.when(k % 6 == 0, "0.0₂4").when(k % 6 == 1, F.concat(price % 1000, F.lit("+"))).otherwise(F.concat(price % 90, F.lit("m"))).alias("volume"),
        F.when(k % 3 == 0, F.concat(price % 50, F.lit("h 30m"))).when(k % 3 == 1, F.concat(price % 60, F.lit("s"))).otherwise(F.concat(price % 60, F.lit(""))).alias("age"), F.col("o_orderkey").alias("pos"), k.alias("seenAt"), F.lit("new-pairs").alias("source"),
    )


def launch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a launch file: pos, value; four of ten are bad in one way each."""
    k = F.col("event_id")
    good = F.concat(F.lit('{"mint":" '), address(F.col("user_id")), F.lit('","name":'), F.when(k % 3 == 0, "7").otherwise(F.concat(F.lit('"N '), F.col("event_type"), F.lit('"'))), F.lit(',"symbol":"'), F.col("event_type"), F.lit('","observedAt":'), F.when(k % 4 == 0, F.lit("-5")).when(k % 4 == 1, F.lit('"x"')).otherwise(k.cast("string")), F.lit("}"))
    line = F.when(k % 10 == 0, '{"mint": tru').when(k % 10 == 1, "[1,2]").when(k % 10 == 2, '{"mint":"short"}').when(k % 10 == 3, "null").otherwise(good)
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).select(k.alias("pos"), line.alias("value"))


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of one card each, in three columns; figures in pieces, some with a subscript."""
    k, bal = F.col("c_custkey"), F.abs(F.floor("c_acctbal")).cast("long")
    mint = address(k)
    heading = F.when(k % 4 == 0, "New Pairs").when(k % 4 == 1, "Final Stretch").when(k % 4 == 2, "Migrated").otherwise("Else")
    cap = F.when(k % 5 == 0, F.concat(F.lit("<b>MC</b><b>$</b><b>"), bal, F.lit("</b><b>K</b>"))).when(k % 5 == 1, F.concat(F.lit("<b>MC $"), bal, F.lit("K</b>"))).when(k % 5 == 2, F.lit("<b>MC</b><b>0.0<sub>5</sub>4</b>")).otherwise(F.concat(F.lit("<b>Mkt Cap:</b><b>$"), bal, F.lit("</b>")))
    named = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<i>"), F.col("c_name"), F.lit("</i>")))
    html = F.concat(F.lit("<section><h2>"), heading, F.lit("</h2><div data-pulse-token-address='"), F.when(k % 6 == 0, "junk").otherwise(mint), F.lit("'><img src='https://cdn.example/"), mint, F.lit(".webp'><b>V</b><b>$12</b>"), cap, F.lit("<i>"), mint.substr(1, 4), F.lit("..."), mint.substr(33, 4), F.lit("</i><i>T"), k % 100, F.lit("</i>"), named, F.lit("<i>"), k % 60, F.when(k % 2 == 0, F.lit("m</i>")).otherwise(F.lit("</i><i>s</i>")), F.lit("<i>0:31</i></div></section>"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")).select(k.alias("page_id"), html.alias("html"))
