"""The corpus pipeline: five stages over documents, each written as Parquet and read back as the next one's input.

Each stage keeps the columns of its documents, further ones too, except the last. Null text counts as empty in every
stage; a row with a null doc_id is judged by its text alone; repeated rows are judged alike, save that near-dedup keeps
one; ties go to the smaller doc_id; an empty table gives an empty table. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import bpe, decontam, linededup, simhash, toxicity
from echofold.llm.queries import table, tokenizer_path
from echofold.llm.storage import settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned from labels, scores 0.5 or more (none goes where it has nothing to learn from)."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that are boilerplate of their source; n_chars follows, where there is that column. A text whose
    lines all go stays as an empty one; null text stays null."""
    clean = linededup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the smallest doc_id alone of each group of near copies: sets of five-word shingles with a similarity of 0.8 or
    more, linked; texts without a word are one group."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; without items all stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text that they decode to; null text has no ids."""
    found = bpe.encode(docs, tokenizer_path(), decoded=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("BPE encoding and decoding", tokenize),
]

#: A trained classifier and fingerprints are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
