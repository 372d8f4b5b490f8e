"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, connected components.

The join, in both forms: distinct fingerprints are dealt to buckets; in a bucket, a sorted array is a binary trie; pairs of
its nodes are walked together from the root, differing bits add up, and a pair over the budget, or one that lies within
one component, is dropped. Budgets are walked in turn, smallest first, so dense balls of near copies are joined by their
nearest links and never list all pairs. A bucket yields a forest: one link less than its fingerprints at most. Buckets
over HOT_ROWS are cut in chunks; each two chunks are a unit of their own.

linked_fingerprints(), 64 bits: words split at ASCII white space, 3-word shingles with repeats (fewer words: the whole
sequence), XXH64 with seed 42; a bit is 1 if set in over half of the hashes. No words: zero, linked like any other. 64
bits are five blocks; two fingerprints within 3 bits agree on two blocks at least, so each goes to ten buckets (one for
each choice of two blocks) and every link is found in one of them.

near_duplicates(), 128 bits: sets of five-word shingles (shingle_sets.py) whose similarity is 0.8 or more. Equal sets are
one class. A similarity of 0.8 differs in 19 bits on average, which no choice of blocks covers, so the buckets are bands
of minimum hashes, and the trie join within SET_BUDGET bits gives loose groups. The sets of a group, each shipped once,
are then compared exactly; groups over CHUNK_ROWS sets or CHUNK_BYTES are cut in chunks of which each two are a unit. A
link is never made without its exact similarity; one at 0.8 is missed with a chance of about 0.0005, one at 0.85 with
less than 0.00001.

Defined results: null text counts as empty (fingerprint zero, one class); repeated rows repeat their result; a null key takes part
in linking, but component_id is the smallest non-null key (null if there is none); an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm import shingle_sets
from echofold.llm.batches import lean, slices, utf8_view
from echofold.llm.components import components, hook
from echofold.llm.storage import settled

SHINGLE, SEED, BUDGET = 3, 42, 3
SLICE_BYTES = 1 << 20
HOT_ROWS = 4096
BROADCAST_ROWS = 10_000
FRONTIER = 1 << 20
SIMILARITY = 0.8
SET_BUDGET = 34
SET_BUDGETS = (8, 16, 24, SET_BUDGET)
CHUNK_ROWS, CHUNK_BYTES = 8192, 32 << 20
SMALL_CHUNK, SMALL_CHUNKS = 1024, 8  # smaller groups are cut too, in fewer chunks, so that several tasks share one
BLOOM_BITS = 26
PARTS = 256  # tasks that can share one component while it is named
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit from the left, bits
PAIRS = list(combinations(BLOCKS, 2))


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A uint64 for each text."""
    raw, offs = utf8_view(column)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8).tobytes()
    digest, found, count = xxhash.xxh64_digest, [], np.zeros(len(offs), np.int64)
    bounds = offs.tolist()
    for i in range(len(bounds) - 1):
        words = raw[bounds[i] : bounds[i + 1]].split()
        if len(words) <= shingle:
            if words:
                found.append(digest(b" ".join(words), seed))
                count[i + 1] = 1
            continue
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        text = b" ".join(words)
        begin = (ends - size)[: len(words) - shingle + 1].tolist()
        found += [digest(text[a:b], seed) for a, b in zip(begin, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        count[i + 1] = len(begin)
    at = np.cumsum(count)
    bits = np.unpackbits(np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(at) - 1, 64), np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(bits, at[full], axis=0, dtype=np.int64)
    return np.packbits(out * 2 > (at[1:] - at[:-1])[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, and fp long (the 64 bits as a signed integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1)).view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("t")).mapInArrow(lean(run), f"key {kind}, fp long").withColumnRenamed("key", key)


def trie_links(unit: np.ndarray, fp: np.ndarray, budgets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) whose links span, in each unit, the same components as all pairs of fp (n x words, the first word
    most significant) within the last budget."""
    order = np.lexsort((*fp.T[::-1], unit))
    unit, fp = unit[order], np.ascontiguousarray(fp[order])
    n, words = fp.shape
    edge = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    lo, hi = edge, np.append(edge[1:], n)
    wide = hi - lo > 1
    ones: dict[int, np.ndarray] = {}
    root = np.arange(n)

    def ones_at(level: int) -> np.ndarray:
        if level not in ones:
            word = fp[:, words - 1 - level // 64]
            ones[level] = np.append(0, np.cumsum((word >> np.uint64(level % 64)) & np.uint64(1))).astype(np.int32)
        return ones[level]

    def walk(allowed: int) -> None:
        nonlocal root
        zero = np.zeros(wide.sum(), np.int16)
        stack = [(64 * words - 1, lo[wide], hi[wide], lo[wide], hi[wide], zero)]
        change = np.cumsum(np.append(0, root[1:] != root[:-1]))
        while stack:
            level, a0, a1, b0, b1, d = stack.pop()
            while len(a0):
                if len(a0) > FRONTIER:
                    half = len(a0) // 2
                    stack.append((level, *(x[half:] for x in (a0, a1, b0, b1, d))))
                    a0, a1, b0, b1, d = (x[:half] for x in (a0, a1, b0, b1, d))
                    continue
                same = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (root[a0] == root[b0])
                single = (a1 - a0 == 1) & (b1 - b0 == 1)
                end = ~same if level < 0 else single & ~same
                if end.any():
                    i, j = a0[end], b0[end]
                    near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= allowed
                    if near.any():
                        root = hook(root, i[near], j[near])
                        change = np.cumsum(np.append(0, root[1:] != root[:-1]))
                if level < 0:
                    break
                go = ~same & ~single
                a0, a1, b0, b1, d = (x[go] for x in (a0, a1, b0, b1, d))
                c = ones_at(level)
                am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
                own = (a0 == b0) & (a1 == b1)
                kids = [(a0, am, b0, bm, d, am - a0 > own), (am, a1, bm, b1, d, a1 - am > own), (a0, am, bm, b1, d + 1, None), (am, a1, b0, bm, d + 1, ~own)]
                parts = []
                for x0, x1, y0, y1, e, ok in kids:
                    keep = (x1 > x0) & (y1 > y0) & (e <= allowed)
                    if ok is not None:
                        keep &= ok
                    parts.append([x[keep].astype(y.dtype) for x, y in zip((x0, x1, y0, y1, e), (a0, a1, b0, b1, d), strict=True)])
                a0, a1, b0, b1, d = (np.concatenate(x) for x in zip(*parts, strict=True))
                level -= 1

    for allowed in budgets:
        walk(allowed)
    far = np.flatnonzero(root != np.arange(n))
    return order[far], order[root[far]]


def trie_forest(unit: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of 64-bit fingerprints of one unit that span the same components as all pairs within the budget."""
    a, b = trie_links(unit, fp[:, None], tuple(range(1, budget + 1)))
    return fp[a], fp[b]


def bucket_links(keyed: DataFrame, fp: list[str], budgets: tuple[int, ...]) -> DataFrame:
    """Links a, b (long) of the ids of keyed, whose rows are id, bucket and the words of fp (all long), a row for each
    bucket of an id: in each bucket enough to span its components."""
    words = len(fp)
    hot = settled(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("bucket", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("chunks")), "simhash-hot")
    few = hot.limit(BROADCAST_ROWS + 1).count()
    if few:
        keyed = keyed.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, "bucket", "left")
        keyed = keyed.select("id", *fp, "bucket", F.explode(chunk_units(F.xxhash64("id"), F.coalesce("chunks", F.lit(1)))).alias("part"))
    else:
        keyed = keyed.withColumn("part", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            unit, ids, fp_ = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = trie_links(unit, fp_, budgets)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            unit, ids, *of = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            rows = unit, ids, np.stack(of, axis=1).view(np.uint64)
            if size > FRONTIER // words**3 and len(unit):  # the rows are sorted by unit: a unit is whole before the next begins
                new = np.flatnonzero(unit != held[-1][0][-1])
                cut = int(new[0]) if len(new) else len(unit)
                held.append(tuple(x[:cut] for x in rows))
                rows = tuple(x[cut:] for x in rows)
                if len(rows[0]):
                    yield links(held)
                    held, size = [], 0
            if len(rows[0]):
                held.append(rows)
                size += len(rows[0])
        if held:
            yield links(held)

    rows = keyed.select(F.xxhash64("bucket", "part").alias("unit"), "id", *fp).repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(lean(run), "a long, b long").where("a <> b")


def chunk_units(spread: Column, chunks: Column) -> Column:
    """The units of a row in a group of so many chunks: one if it is whole, else one for each other chunk."""
    chunk = F.pmod(spread, chunks).cast("int")
    other = F.filter(F.sequence(F.lit(0), chunks.cast("int") - 1), lambda x: x != chunk)
    return F.when(chunks <= 1, F.array(F.lit(0))).otherwise(F.transform(other, lambda x: (F.least(x, chunk) * chunks + F.greatest(x, chunk) + 1).cast("int")))


def near_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links a, b (long) of a column of distinct 64-bit fingerprints, enough to span their components within BUDGET bits."""
    own = F.col("id")
    bits = lambda first, n: F.shiftrightunsigned(own, 64 - first - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    keys = F.array(*[F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(bits(a, n), m)).bitwiseOR(bits(b, m)) for k, ((a, n), (b, m)) in enumerate(PAIRS)])
    keyed = fps.select(fps[fp].alias("id")).select("id", F.col("id").alias("fp"), F.explode(keys).alias("bucket"))
    return bucket_links(keyed, ["fp"], tuple(range(1, BUDGET + 1)))


def linked_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fingerprint string (16 lowercase hex digits), component_id (the smallest key reachable by links of 3 bits or fewer)."""
    own = settled(fingerprints(docs, key, text), "simhash-fp")
    fps = own.groupBy("fp").agg(F.min(key).alias("least"))
    named = settled(named_components(fps, "fp", components(near_links(own.select("fp").distinct()))), "simhash-named")
    return own.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named_components(classes: DataFrame, of: str, found: DataFrame) -> DataFrame:
    """of, component_id: the smallest `least` of the classes in each one's component; found: node, component.

    Classes without links are not shuffled by component. The others meet their component's name by component and one of
    PARTS parts of it, so that several tasks share a large component; a name goes to those parts alone that have classes.
    """
    part = F.pmod(F.xxhash64(of), F.lit(PARTS)).cast("int").alias("part")
    named = settled(classes.join(found, classes[of] == found.node, "left").select(of, "least", "component", part), "simhash-classes")
    linked = named.where("component IS NOT NULL")
    parts = linked.groupBy("component", "part").agg(F.min("least").alias("least"))
    first = parts.groupBy("component").agg(F.min("least").alias("first"), F.collect_list("part").alias("parts"))
    first = first.select("component", "first", F.explode("parts").alias("part"))
    alone = named.where("component IS NULL").select(of, F.col("least").alias("component_id"))
    return linked.join(first, ["component", "part"]).select(of, F.col("first").alias("component_id")).union(alone)


FP = [f"f{w}" for w in range(shingle_sets.FP_WORDS)]


def set_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, cls long (its set's digest), the words of FP, and bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE_BYTES):
            code, at = shingle_sets.sets_of(part.column(1))
            cls, fp, keys = shingle_sets.digests(code, at), shingle_sets.fingerprints(code, at), shingle_sets.bands(code, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * shingle_sets.BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls.view(np.int64)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fp.T), lists], ["key", "cls", *FP, "bands"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, cls long, {', '.join(f'{f} long' for f in FP)}, bands array<long>"
    return docs.select(docs[key].alias("key"), docs[text].alias("t")).mapInArrow(lean(run), schema)


def sets_of(docs: DataFrame, text: str) -> DataFrame:
    """cls, the words of FP and shingles binary (64-bit hashes, sorted), a row for the first text of each class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "t", SLICE_BYTES):
            code, at = shingle_sets.sets_of(part.column(0))
            cls, fp = shingle_sets.digests(code, at), shingle_sets.fingerprints(code, at)
            new = [k for k, c in enumerate(cls.tolist()) if c not in seen and not seen.add(c)]
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)[new]), *(pa.array(np.ascontiguousarray(x[new]).view(np.int64)) for x in fp.T), pa.array([code[at[k] : at[k + 1]].tobytes() for k in new], pa.binary())], ["cls", *FP, "shingles"])

    return docs.select(docs[text].alias("t")).mapInArrow(lean(run), f"cls long, {', '.join(f'{f} long' for f in FP)}, shingles binary")


def similar_links(sets: DataFrame, groups: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links a, b of classes, in the groups node, component, whose sets have that similarity or more; sets: sets_of() rows."""
    sets = sets.join(groups, F.col("cls") == F.col("node")).dropDuplicates(["cls"]).select("cls", *FP, "shingles", "component")
    sets = settled(sets, "simhash-sets")
    size = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    chunks = F.greatest(F.least(F.ceil(F.col("n") / SMALL_CHUNK), F.lit(SMALL_CHUNKS)), F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    large = settled(size.select(F.col("component").alias("_large"), chunks.alias("chunks")).where("chunks > 1"), "simhash-large")
    few = large.limit(BROADCAST_ROWS + 1).count()
    if few:
        sets = sets.join(F.broadcast(large) if few <= BROADCAST_ROWS else large, F.col("component") == F.col("_large"), "left")
        sets = sets.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    else:
        sets = sets.withColumn("chunks", F.lit(1))
    spread = F.xxhash64("cls", F.lit(3))
    sets = sets.withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int")).withColumn("part", F.explode(chunk_units(spread, F.col("chunks"))))
    low, high = F.floor((F.col("part") - 1) / F.col("chunks")), F.pmod(F.col("part") - 1, F.col("chunks"))
    # a chunk's own pairs are compared in the units of neighbours; in the others they are passed over
    side = F.when((F.col("part") > 0) & (high != low + 1) & (F.col("chunk") == high), 1).otherwise(0)
    units = sets.select(F.xxhash64("component", "part").alias("unit"), "cls", side.alias("side"), *FP, "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            cls, side = table["cls"].to_numpy(), table["side"].to_numpy()
            fp = np.stack([table[f].to_numpy() for f in FP], axis=1).view(np.uint64)
            raw, offs = utf8_view(table["shingles"])
            i, j = shingle_sets.similar(side, fp, np.frombuffer(raw.tobytes(), np.uint64), offs // 8, least, SET_BUDGET)
            return pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            unit = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and len(unit) and held[0].column(0)[0].as_py() != unit[a]:
                    yield links(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: key, fingerprint string (32 lowercase hex digits), component_id (the smallest key reachable by links of
    that similarity or more)."""
    own = settled(set_classes(docs, key, text), "simhash-own")
    classes = settled(own.groupBy("cls", *FP, "bands").agg(F.min("key").alias("least")), "simhash-least")
    keyed = classes.select(F.col("cls").alias("id"), *FP, F.explode("bands").alias("bucket")).where("bucket <> 0")
    groups = settled(components(bucket_links(keyed, FP, SET_BUDGETS)), "simhash-groups")
    first = settled(classes.join(groups, F.col("cls") == F.col("node")).where("least IS NOT NULL").select(F.col("least").alias("_least")), "simhash-first")
    found = components(similar_links(sets_of(within(docs, first, key, "_least"), text), groups, similarity))
    named = settled(named_components(classes.select("cls", "least"), "cls", found), "simhash-named")
    digits = F.lower(F.concat(*[F.lpad(F.hex(f), 16, "0") for f in FP]))
    return own.select("key", "cls", *FP).join(named, "cls").select(F.col("key").alias(key), digits.alias("fingerprint"), "component_id")


def bloom(ids: DataFrame, key: str, n: int) -> Callable[[Column], Column]:
    """A test of a key that holds for all n of ids and for few others. Its bits are made by Spark and are at most 2 **
    BLOOM_BITS (8 MB) however many ids there are; beyond some millions more others pass it, which costs time alone."""
    bits = min(1 << BLOOM_BITS, max(1 << 10, 1 << int(np.ceil(np.log2(max(1, 16 * n))))))
    place = lambda k, salt: F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(bits))
    at = ids.select(F.explode(F.array(*[place(F.col(key), s) for s in (1, 2, 3)])).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
    table = np.zeros(bits // 64, np.int64)
    found = words.toArrow()  # at most bits / 64 rows
    table[found["w"].to_numpy()] = found["v"].to_numpy()
    held = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def holds(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = [(held.value[x.to_numpy() >> 6] >> (x.to_numpy() & 63)) & 1 for x in (a, b, c)]
        return pd.Series((hit[0] & hit[1] & hit[2]).astype(bool))

    return lambda k: holds(*[place(k, s) for s in (1, 2, 3)])


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not in ids. While ids are few they are broadcast; else a bounded filter tells most
    other rows, which stay where they are, and only the rest is shuffled."""
    n = ids.count()
    if not n:
        return docs
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), key, "left_anti").select(*docs.columns)
    free = "_likely" + "_" * max(map(len, docs.columns))  # a name that docs don't have
    marked = docs.withColumn(free, bloom(ids, key, n)(F.col(key)))
    likely = marked.where(F.col(free)).select(*docs.columns).join(ids, key, "left_anti").select(*docs.columns)
    return marked.where(~F.col(free)).select(*docs.columns).unionByName(likely)


def within(docs: DataFrame, ids: DataFrame, key: str, of: str) -> DataFrame:
    """At least the rows of docs whose key is null or in the column `of` of ids; other rows only as bloom() lets them pass."""
    n = ids.count()
    if n <= BROADCAST_ROWS:
        held = ids.select(of).distinct()
        return docs.join(F.broadcast(held), docs[key] == held[of], "left_semi").unionByName(docs.where(docs[key].isNull()))
    return docs.where(docs[key].isNull() | bloom(ids, of, n)(docs[key]))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those whose component has a smaller key; rows of one key and text count as one document.

    Rows with a null key stay, as they can't be told from one another.
    """
    found = settled(near_duplicates(docs, key, text, similarity).select(key, "component_id"), "simhash-kept")
    stay = without(docs, settled(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "simhash-drops"), key)
    again = settled(found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "simhash-again")
    if again.isEmpty():
        return stay
    return stay.join(again, key, "left_anti").select(*docs.columns).unionByName(stay.join(again, key, "left_semi").select(*docs.columns).dropDuplicates([key, text]))
