"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is its lower-cased words (runs of letters and numbers); a word is itself and the 3- to 5-grams of its characters
between word marks, hashed to BUCKETS, so a misspelling shares most of its vectors with the word. A text's vector is the
mean of its subwords' vectors and of PRIOR zero vectors, so that a few words alone don't tip it, and a linear softmax
over it gives the two classes. Vectors and softmax are trained together with Adam on a bounded sample: at most SAMPLE
rows without toxicity and half as many with it, those with the smallest hash of the key. Their bags are made in
parallel; one task fits on them, whose size does not grow with the table. A small sample is passed over more often, so
that about ROWS_SEEN rows are learned from in all. PRIOR, SCALE, RATE, DIM and ROWS_SEEN were chosen on an inner fold of the
rows that may be learned from (crc32 mod 5 of 1, the others fitted on), never on held-out ones.

Defined results: null text, and text without a word, has the score of the bias alone; with no labelled rows of both
classes the score is 0 for all; label rows with a null key or label are not learned from; a key that repeats in the
table is learned from once (its smallest text); rows are independent, so repeated rows repeat their score; an empty
table gives an empty table.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.batches import code_points, lean, slices, spans, sums, utf8_view
from echofold.llm.bpe import LETTER, NUMBER, char_classes

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
ORDERS = (3, 4, 5)
DIM = 4
SAMPLE = 4000  # rows without toxicity; half as many with
ROWS_SEEN, MOST_EPOCHS = 72_000, 64
BATCH = 64
RATE = 0.05
SCALE = 15.0
PRIOR = 800
SLICE_BYTES = 1 << 20
TRAIN_SLICE_BYTES = 1 << 18


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as bytes and bounds, the word of each token, and the rows' bounds among the tokens."""
    raw, offs = utf8_view(pc.utf8_lower(column))
    cps, at = code_points(raw)
    kind = char_classes(cps)
    word = (kind == LETTER) | (kind == NUMBER)
    cut = np.zeros(len(cps) + 1, bool)
    cut[np.searchsorted(at, offs)] = True
    begin = np.flatnonzero(cut[:-1] | np.append(True, word[1:] != word[:-1])[: len(word)])
    runs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(at[begin], len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    is_word = word[begin]
    coded = runs.filter(pa.array(is_word)).dictionary_encode()
    flat, bounds = utf8_view(coded.dictionary)
    counts = np.concatenate([[0], np.cumsum(is_word)])
    return flat, bounds, coded.indices.to_numpy(zero_copy_only=False), counts[np.searchsorted(at[begin], offs)]


def subwords(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's subwords, and the words' bounds among them."""
    n = len(bounds) - 1
    cps, at = code_points(flat)
    own = np.searchsorted(at, bounds)
    size = np.diff(own)
    marked = np.full(len(cps) + 2 * n, ord("<"), np.uint32)
    first = own[:-1] + 2 * np.arange(n)
    marked[np.arange(len(cps)) + np.repeat(2 * np.arange(n) + 1, size)] = cps
    marked[first + size + 1] = ord(">")
    ends = np.repeat(first + size + 2, size + 2)
    row = np.repeat(np.arange(n), size + 2)
    code = (marked + np.uint32(1)) * np.uint32(0x9E3779B1)
    found, rows = [], []
    rolled = np.zeros(len(marked), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        m = len(marked) - k + 1
        if m <= 0:
            break
        rolled = (rolled[:m] * np.uint32(0x01000193)) ^ code[k - 1 :]
        if k in ORDERS:
            inside = np.arange(k, k + m) <= ends[:m]
            found.append((((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k)) >> np.uint32(32 - BUCKET_BITS))[inside])
            rows.append(row[:m][inside])
    whole = np.zeros(n, np.uint32)  # the word itself: a sum of its characters' codes, each turned by its place
    if len(marked):
        place = (np.arange(len(marked)) - np.repeat(first, size + 2)).astype(np.uint32)
        whole = np.add.reduceat(code * (place * np.uint32(2654435769) | np.uint32(1)), first, dtype=np.uint32)
    found.append((whole ^ (whole >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS))
    rows.append(np.arange(n))
    rows, found = np.concatenate(rows), np.concatenate(found).astype(np.int64)
    order = np.argsort(rows, kind="stable")
    return found[order], np.searchsorted(rows[order], np.arange(n + 1))


def packed_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, label, t as key, label and the row's bag: buckets (int32) and shares (float32) as binary."""
    for part in slices(batches, "t", TRAIN_SLICE_BYTES):
        bucket, share, at = bags(part.column(2))
        offs = pa.py_buffer((at * 4).astype(np.int32))
        own = [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offs, pa.py_buffer(np.ascontiguousarray(x))]) for x in (bucket.astype(np.int32), share)]
        yield pa.RecordBatch.from_arrays([*part.columns[:2], *own], ["key", "label", "bucket", "share"])


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each row, their weight (the share of the row's subwords and PRIOR), and the rows' bounds."""
    flat, bounds, token, rows = words_of(column)
    bucket, own = subwords(flat, bounds)
    count = np.diff(own)[token]
    all_buckets = bucket[spans(own[:-1][token], count)]
    per_row = np.concatenate([[0], np.cumsum(count)])[rows]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(per_row))
    key, n = np.unique(row * BUCKETS + all_buckets, return_counts=True)
    at = np.searchsorted(key, np.arange(len(rows)) * BUCKETS)
    row = key // BUCKETS
    return key % BUCKETS, (n / (np.diff(per_row)[row] + PRIOR)).astype(np.float32), at


def fit(bag: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Vectors E (BUCKETS x DIM), softmax W (2 x DIM) and bias b (2)."""
    bucket, share, at = bag
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    prior = np.array([weights[labels == c].sum() for c in (0, 1)])
    b = np.log(prior / prior.sum()).astype(np.float32)
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("E", E), ("W", W), ("b", b))}
    step = 0
    epochs = min(MOST_EPOCHS, -(-ROWS_SEEN // max(1, len(labels))))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            count = at[own + 1] - at[own]
            place = spans(at[own], count)
            ids, part = bucket[place], share[place] * np.float32(SCALE)
            row = np.repeat(np.arange(len(own)), count)
            mean = sums(E[ids] * part[:, None], np.concatenate([[0], np.cumsum(count)]))
            logit = mean @ W.T + b
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            g = (p * (weights[own] / weights[own].sum())[:, None]).astype(np.float32)
            back = g @ W
            used = np.flatnonzero(np.bincount(ids, minlength=BUCKETS))
            gE = np.stack([np.bincount(ids, weights=part * back[row, d], minlength=BUCKETS)[used] for d in range(DIM)], axis=1).astype(np.float32) + np.float32(1e-6) * E[used]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, x, grad, rows in (("E", E, gE, used), ("W", W, g.T @ mean, slice(None)), ("b", b, g.sum(axis=0), slice(None))):
                m, v = moments[name]
                m[rows] = 0.9 * m[rows] + 0.1 * grad
                v[rows] = 0.999 * v[rows] + 0.001 * grad**2
                x[rows] -= (rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)).astype(np.float32)
    return {"E": E, "W": W, "b": b}


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of class 1 for each text, in float64."""
    worth = (model["E"] @ (model["W"][1] - model["W"][0])).astype(np.float64)
    flat, bounds, token, rows = words_of(column)
    bucket, own = subwords(flat, bounds)
    value, size = sums(worth[bucket], own), np.diff(own)
    n = sums(size[token], rows)
    mean = sums(value[token], rows) / (n + PRIOR)
    return 1 / (1 + np.exp(-(SCALE * mean + float(model["b"][1] - model["b"][0]))))


def held_out(key: Column) -> Column:
    """A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The model, or None without labelled rows of both classes."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    taken = [known.where(F.col("label") == c).orderBy(F.xxhash64(F.col("key").cast("string"), F.lit(11)), "key").limit(sample // (1 + c)) for c in (0, 1)]
    rows = docs.select(docs[key].alias("key"), docs[text].alias("t")).join(F.broadcast(taken[0].union(taken[1])), "key")  # at most 1.5 * sample rows
    rows = rows.groupBy("key", "label").agg(F.min("t").alias("t"))
    rows = rows.mapInArrow(lean(packed_bags), f"key {docs.schema[key].dataType.simpleString()}, label int, bucket binary, share binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, count, bucket, share = [], [], bytearray(), bytearray()  # grown in place, a batch at a time
        for batch in batches:
            raw, offs = utf8_view(batch.column(1))
            y.append(batch.column(0).to_numpy(zero_copy_only=False))
            count.append(np.diff(offs) // 4)
            bucket += memoryview(raw)
            share += memoryview(utf8_view(batch.column(2))[0])
        y = np.concatenate([*y, np.zeros(0, np.int64)]).astype(np.int64)
        if len(set(y.tolist())) < 2:
            return
        weight = np.array([counts[c] / max(1, (y == c).sum()) for c in (0, 1)])[y].astype(np.float32)
        out = io.BytesIO()
        bag = np.frombuffer(bucket, np.int32), np.frombuffer(share, np.float32), np.concatenate([[0], np.cumsum(np.concatenate(count))])
        np.savez(out, **fit(bag, y, weight))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions("key").select("label", "bucket", "share").mapInArrow(lean(run), "model binary").collect()  # one row
    return dict(np.load(io.BytesIO(found[0].model))) if found else None


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score double, predicted int (1 if score >= 0.5)."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE_BYTES):
            score = scores(part.column(1), held.value) if held.value else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["key", "score"])

    return docs.select(docs[key].alias("key"), docs[text].alias("t")).mapInArrow(lean(run), f"key {kind}, score double").select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is under 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            yield part.filter(pa.array(scores(part.column(at), held.value) < 0.5)) if held.value else part

    return docs.mapInArrow(lean(run), docs.schema)
