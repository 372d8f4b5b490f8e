"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every run of non-letters is one blank, and the 1- to 4-grams of each text are hashed to BUCKETS.
Counts come from a bounded sample: about SAMPLE rows of each language, taken by a hash of the key. The log-probability
matrix (languages x BUCKETS, float32) goes to the executors in blocks of BLOCK_LANGUAGES languages, 64 MB each; a batch is
scored as a sparse product: the matrix rows of all its n-grams, summed between the texts' bounds. More languages are more
blocks, counted and scored one after the other, with the best so far and the sum of all carried along; names of languages
alone are held for all blocks at once.

Defined results: null text and text without a letter are `und` with score 0; with nothing to learn from, every text is
`und`; ties go to the language that sorts first; rows are independent, so repeated rows repeat their result (and count
as often in the sample); a null key is an ordinary value that is never learned from; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.batches import code_points, lean, slices, sums, utf8_view
from echofold.llm.bpe import LETTER, char_classes

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3, 4)
SAMPLE = 2000
BLOCK_LANGUAGES = 500
Model = list[tuple[list[str], np.ndarray]]
SMOOTHING = 0.5
SLICE_BYTES = 1 << 20
NONE = "und"
_MIX = np.uint32(0x9E3779B1)


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with each run of non-letters as one blank, each text between two blanks, and the texts' bounds."""
    raw, offs = utf8_view(pc.utf8_lower(column))
    cps, at = code_points(raw)
    bounds = np.searchsorted(at, offs)
    letter = char_classes(cps) == LETTER
    first = np.zeros(len(cps) + 1, bool)
    first[bounds] = True
    keep = letter | np.append(False, letter[:-1]) & ~first[:-1] if len(cps) else letter
    before = np.concatenate([[0], np.cumsum(keep)])[bounds]
    text = np.where(letter, cps, 32)[keep].astype(np.uint32)
    out = np.full(len(text) + len(offs) - 1, 32, np.uint32)  # a blank before each text
    row = np.repeat(np.arange(len(offs) - 1), np.diff(before))
    out[np.arange(len(text)) + row + 1] = text
    return out, before + np.arange(len(offs))


def grams(text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram at each place, and the rows' bounds among them."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    code = text * _MIX
    rolled = np.zeros(len(text), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        k = len(text) - n + 1
        if k <= 0:
            return
        rolled = (rolled[:k] * np.uint32(0x01000193)) ^ code[n - 1 :]
        if n not in ORDERS:
            continue
        inside = np.arange(n, n + k) <= ends[:k]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        yield (mixed >> np.uint32(32 - BUCKET_BITS))[inside].astype(np.int64), np.append(0, np.cumsum(inside))[np.minimum(bounds, k)]


def held_out(key: Column) -> Column:
    """A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Blocks of languages in order, each with the float32 matrix BUCKETS x languages of log-probabilities, its last row the log-priors."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("t"), docs[lang].alias("lang")).where(F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names, every = sorted(counts), sum(counts.values())
    out = []
    for k in range(0, len(names), BLOCK_LANGUAGES):
        own = names[k : k + BLOCK_LANGUAGES]
        total = _counts(rows.where(F.col("lang").isin(own)) if len(own) < len(names) else rows, own, {x: min(1.0, sample / counts[x]) for x in own})
        logs = np.log(total + SMOOTHING) - np.log((total + SMOOTHING).sum(axis=1, keepdims=True))
        prior = np.log(np.array([counts[x] for x in own]) / every)
        out.append((own, np.concatenate([logs.T, prior[None]]).astype(np.float32)))
    return out


def _counts(rows: DataFrame, names: list[str], shares: dict[str, float]) -> np.ndarray:
    """Sampled counts, languages x BUCKETS; each language's share is taken."""
    share = F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, shares[name])]), F.col("lang"))
    taken = rows.where(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    at = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for part in slices(batches, "t", SLICE_BYTES):
            of = np.array([at[x] for x in part.column(1).to_pylist()], np.int64)
            text_, bounds = letters_of(part.column(0))
            for bucket, own in grams(text_, bounds):
                row = np.repeat(of, np.diff(own))
                total += np.bincount(row * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in total], pa.binary())], ["lang", "counts"])

    total = np.zeros((len(names), BUCKETS), np.int64)
    for r in taken.select("t", "lang").repartition(4).mapInArrow(lean(count), "lang string, counts binary").toLocalIterator():
        total[at[r.lang]] += np.frombuffer(r.counts, np.int64)
    return total


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred string, score double (the posterior of that language)."""
    kind = docs.schema[key].dataType.simpleString()
    least = F.lit(float("-inf"))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("t"), F.lit(None).cast("string").alias("lang"), least.alias("best"), least.alias("total"))
    for place, (names, matrix) in enumerate(model):
        held, last = docs.sparkSession.sparkContext.broadcast(matrix), place == len(model) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, names=names, last=last) -> Iterator[pa.RecordBatch]:
            table = held.value
            for part in slices(batches, "t", SLICE_BYTES):
                text_, bounds = letters_of(part.column(1))
                score = np.tile(table[-1].astype(np.float64), (len(bounds) - 1, 1))
                for bucket, own in grams(text_, bounds):
                    for k in range(len(names)):
                        score[:, k] += sums(table[:, k][bucket].astype(np.float64), own)
                lang, best, total = (part.column(k).to_numpy(zero_copy_only=False).copy() for k in (2, 3, 4))
                some = np.flatnonzero(np.diff(bounds) > 1)  # texts with a letter
                top = score[some].max(axis=1)
                new = some[top > best[some]]  # of equal languages the one before stays
                lang[new] = np.array(names, object)[score[new].argmax(axis=1)]
                total[some] = np.logaddexp(total[some], top + np.log(np.exp(score[some] - top[:, None]).sum(axis=1)))
                best[some] = np.maximum(best[some], top)
                text_column = pa.nulls(part.num_rows, pa.string()) if last else part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), text_column, pa.array(lang, pa.string()), pa.array(best), pa.array(total)], ["key", "t", "lang", "best", "total"])

        rows = rows.mapInArrow(lean(run), f"key {kind}, t string, lang string, best double, total double")
    score = F.when(F.col("lang").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("total"))))
    return rows.select(F.col("key").alias(key), F.coalesce("lang", F.lit(NONE)).alias("lang_pred"), score.alias("score"))
