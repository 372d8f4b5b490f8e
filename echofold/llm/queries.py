"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import ann, bpe, codes, decontam, html_extract, langid, licenses, linededup, quality, simhash, toxicity, warc, whitening
from echofold.llm.storage import scratch


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), also=("url",))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents"), dropped="n_dropped").select("doc_id", "text", "n_dropped")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked_fingerprints(table(spark, sf_dir, "documents"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.names_of(licenses.scan(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = scratch(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write(warc.captures(pages), path, pages.agg(F.max(F.octet_length("html"))).first()[0] or 0)
    rows = warc.transactions(warc.read(spark, path))
    size = F.coalesce(F.octet_length("response.payload").cast("long"), F.col("metadata.payload_bytes"))  # of a response as assembled, of a revisit as noted
    return rows.select(
        F.col("metadata.key").cast("long").alias("page_id"), size.alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("response.refers_to").cast("long").alias("refers_to"),
    )


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.train(vectors)
    found = codes.with_group_error(codes.compress(vectors, books, "vec_id", "embedding", "label"), "label")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents")).drop("ratio", "bad_share")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe, "op2_html": op2_html, "op3_langid": op3_langid, "op4_ann": op4_ann, "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash, "op7_license": op7_license, "op8_decontamination": op8_decontamination, "op9_toxicity": op9_toxicity, "op10_warc": op10_warc,
    "op11_codes": op11_codes, "op12_whitening": op12_whitening, "op13_quality": op13_quality,
}
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": linededup.ORACLE_SQL, "op7_license": licenses.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op11_codes": codes.ORACLE_SQL}
