"""Single-link clusters of records whose names or symbols match.

Records are linked through their keys: two records match if any key of one matches any key of the other, so components
of the graph of keys (a record ties its keys together) are those of the records, and equal keys need no pairs. Keys are
numbered, so that what moves between rounds is numbers.

Which keys match is an indexed self-join. A score of bar with a common prefix of p characters needs m characters in common
with m / na + m / nb at or over a number S(p), so at least a = S na nb / (na + nb) of them. Take a key's characters as tokens
(the character, and how many of it came before), rarest first: of two keys that share a tokens, the first n - a + l of either
have l of them in common. So each key is filed under all sets of l of those few tokens, by band of length; the shorter key of a
pair stands in the index under its own length's band, the longer one asks in the bands that it can reach. Of few letters single
tokens tell keys apart badly, and pairs grow with the square of a block; l is so large as a band's number of sets allows, and who
would ask for too many asks for single tokens. Pairs are looked for in three classes (no first character
in common; one to three; four), as a longer prefix lets S fall. In the join's own condition, a bound from bit masks of the tokens
and the prefix that the two do share, and one from their edits, then leave few pairs to score: m characters that match, t of them
out of order, make a distance of na + nb - 2 m + t at most, and the score lets t be T(m) = 2 m (m / na + m / nb - S); as that sum is
convex in m, it is greatest at the least m or at the most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations, repeat, takewhile
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.similarity import PREFIX, SCALE, jaro_winkler
from echofold.model import THRESHOLDS, Thresholds
from echofold.sources.store import settled

COMMON_TOKENS = 10_000
#: Longer keys are not carried to the pairs, whose edits so stay uncounted.
EDITED_CHARS = 32
#: Characters of a common prefix that a class's keys share, and the longest prefix that its pairs are scored with.
CLASSES = [(0, 0), (1, PREFIX - 1), (PREFIX, PREFIX)]
#: Bits of a mask: a letter or digit's first, second and further places; other characters share the rest.
TIMES, OTHERS, WORDS = 3, 20, 2
BAND_GROWTH = 1.25
#: The most tokens of a set, by class (keys with a prefix in common are few already), the most sets of a key, and keys a task.
TOGETHER, SETS, KEYS_A_TASK = (6, 4, 1), 24, 50_000
SCORE_AT_ONCE = 1 << 22
BROADCAST_KEYS, BROADCAST_CHARS = 1_000_000, 32_000_000


def connected(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of a column pair a, b: minimum labels over links, with labels of labels."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:  # each round lowers some label, or is the last
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = step.join(jump, step.root == jump._n, "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root"), "was")
        step = settled(step, "labels")
        labels = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return labels


def shared_least(bar: float, prefix: int) -> float:
    """m / na + m / nb is at least this where m characters match and a score with so long a prefix is bar or more."""
    return 3 * (bar - prefix * SCALE) / (1 - prefix * SCALE) - 1 - 1e-9


def spanning(a: list, b: list) -> tuple[list, list]:
    """As few links as span the components of links a-b."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out: tuple[list, list] = ([], [])
    for x, y in zip(a, b, strict=True):
        if (p := root(x)) != (q := root(y)):
            up[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def tokens(key: str) -> list[int]:
    """The characters of a key, each with how many of it came before, as numbers."""
    seen: Counter[str] = Counter()
    out = []
    for c in key:
        out.append(ord(c) << 32 | seen[c])
        seen[c] += 1
    return out


def common_tokens(keys: DataFrame) -> dict[int, int]:
    """A rank over all others for the COMMON_TOKENS tokens of most keys; the rest are rarer and go by their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for key in batch.column(0).to_pylist():
                found.update(tokens(key))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    totals = keys.select("key").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = totals.orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).collect()
    return {r.token: 1 << 60 | (COMMON_TOKENS - k) for k, r in enumerate(most)}


def bands(longest: int) -> list[int]:
    """The first length of each band."""
    return list(takewhile(lambda x: x <= longest, accumulate(repeat(0), lambda a, _: max(a + 1, int(a * BAND_GROWTH)), initial=0)))


def mixed(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    h = (h ^ value.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Plan:
    """How keys of some lengths are filed: their bands, and the size of the token sets of each class and band."""

    def __init__(self, lengths: list[int], bar: float):
        self.edges = np.array(bands(max(lengths, default=1)))
        self.shares = [shared_least(bar, most) for _, most in CLASSES]
        self.of_band: dict[int, list[int]] = {}
        for n in sorted(lengths):
            self.of_band.setdefault(self.band(n), []).append(n)
        self.together = {(c, b): self._level(c, own) for c in range(len(CLASSES)) for b, own in self.of_band.items()}
        self.singles = {(c, b) for n in lengths for c in range(len(CLASSES)) for b, _, size in self.asked(c, n) if size < self.together[c, b]}

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def shared(self, c: int, n: int, partner: int) -> int:
        """At least so many tokens are common to keys of these lengths, if they match."""
        return max(1, int(np.ceil(self.shares[c] * n * partner / (n + partner) - 1e-6)))

    def _sets(self, c: int, n: int, partner: int, size: int) -> int:
        return comb(min(n, n - self.shared(c, n, partner) + size), size)

    def _level(self, c: int, lengths: list[int]) -> int:
        most = min(TOGETHER[c], *(self.shared(c, n, n) for n in lengths))
        return max([1, *(k for k in range(1, most + 1) if all(self._sets(c, n, n, k) <= SETS for n in lengths))])

    def asked(self, c: int, n: int) -> list[tuple[int, int, int]]:
        """(band, the least of its lengths that a key of this one can match, size of sets) of a key's questions."""
        shortest = max(1, int(np.ceil((self.shares[c] - 1) * n - 1e-6)))
        least = [(b, next((p for p in own if shortest <= p <= n), 0)) for b, own in self.of_band.items()]
        return [(b, p, k if self._sets(c, n, p, k) <= SETS else 1) for b, p in least if p for k in [self.together[c, b]]]

    def held(self, c: int, n: int) -> list[tuple[int, int, int]]:
        """(band, length, size of sets) of a key's entries."""
        b = self.band(n)
        return [(b, n, k) for k in sorted({self.together[c, b]} | ({1} if (c, b) in self.singles else set()))]


def filed(keys: list[str], rank: dict[int, int], plan: Plan, asks: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in keys, block) of all entries of the index, or of all questions to it. A block's last two bits are its class."""
    of_size: dict[int, list[int]] = {}
    for k, key in enumerate(keys):
        of_size.setdefault(len(key), []).append(k)
    for n, own in of_size.items():
        place = np.array(own)
        ranked = np.sort(np.array([[rank.get(t, t) for t in tokens(keys[k])] for k in own], np.int64), axis=1)
        heads = np.array([[ord(c) for c in keys[k][:PREFIX].ljust(PREFIX, "\0")] for k in own], np.int64)
        for c, (head, _) in enumerate(CLASSES):
            if n < head:
                continue
            h = np.full(len(own), c, np.uint64)
            for k in range(head):
                h = mixed(h, heads[:, k])
            for b, partner, size in (plan.asked if asks else plan.held)(c, n):
                use = min(n, n - plan.shared(c, n, partner) + size)
                if use < size:
                    continue
                start = mixed(mixed(h, np.array([b])), np.array([size]))
                for chosen in combinations(range(use), size):
                    block = start
                    for k in chosen:
                        block = mixed(block, ranked[:, k])
                    yield place, (block & ~np.uint64(3) | np.uint64(c)).view(np.int64)


def masks(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """WORDS words of bits for each key's tokens; its length and how many tokens share a bit with another, as one number; its
    first PREFIX characters as one number, 16 bits each. Two keys have at most as many tokens in common as bits, and as the less
    of their shared ones besides; characters that fall together in a number only make a prefix look longer."""
    out, size, head = np.zeros((len(keys), WORDS), np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
    for k, key in enumerate(keys):
        cells: set[int] = set()
        for t in tokens(key):
            c = t >> 32
            letter = c - 97 if 97 <= c < 123 else 26 + c - 48 if 48 <= c < 58 else -1
            cells.add(letter * TIMES + min(t & 0xFFFFFFFF, TIMES - 1) if letter >= 0 else 36 * TIMES + c % OTHERS)
        for x in cells:
            out[k, x >> 6] |= np.uint64(1 << (x & 63))
        size[k] = len(key) << 32 | len(key) - len(cells)
        for c in key[:PREFIX].ljust(PREFIX, "\0"):
            head[k] = head[k] << np.uint64(16) | np.uint64(ord(c) & 0xFFFF)
    return out.view(np.int64), size, head.view(np.int64)


def near_keys(numbered: DataFrame, bar: float) -> DataFrame:
    """a, b: all pairs of numbered keys (id, key; distinct) that may score bar or more, once each or a few times."""
    sizes = {r.n: r["count"] for r in numbered.groupBy(F.length("key").alias("n")).count().collect()}  # a row a length
    context = numbered.sparkSession.sparkContext
    held = context.broadcast((common_tokens(numbered), Plan(list(sizes), bar)))
    fields = ["id", "size", "head", *[f"m{w}" for w in range(WORDS)], "text", "block"]

    def file(asks: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            mask, size, head = masks(keys)
            rank, plan = held.value
            columns = [pa.array(c) for c in (size, head, *[mask[:, w] for w in range(WORDS)])]
            columns = [batch.column(0), *columns, pa.array([k if len(k) <= EDITED_CHARS else None for k in keys], pa.string())]
            for at, block in filed(keys, rank, plan, asks):
                places = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[c.take(places) for c in columns], pa.array(block)], fields)

    keys = numbered.select("id", "key").repartition(max(context.defaultParallelism, sum(sizes.values()) // KEYS_A_TASK))
    x, y = (keys.mapInArrow(partial(file, asks), ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in fields)).alias(name) for name, asks in (("x", True), ("y", False)))
    length = lambda side: F.shiftright(F.col(f"{side}.size"), 32).cast("double")
    common = sum((F.bit_count(F.col(f"x.m{w}").bitwiseAND(F.col(f"y.m{w}"))) for w in range(WORDS)), F.least(*[F.col(f"{side}.size").bitwiseAND(F.lit(0xFFFFFFFF)) for side in "xy"]))
    prefix, least = F.lit(0), F.lit(shared_least(bar, 0))
    for p in range(1, PREFIX + 1):  # the prefix that they share, and what a score with it takes
        same = F.shiftrightunsigned("x.head", 16 * (PREFIX - p)) == F.shiftrightunsigned("y.head", 16 * (PREFIX - p))
        prefix, least = F.when(same, p).otherwise(prefix), F.when(same, shared_least(bar, p)).otherwise(least)
    of_class = F.when(prefix == 0, 0).when(prefix < PREFIX, 1).otherwise(2)
    longer = (length("x") > length("y")) | ((length("x") == length("y")) & (F.col("x.id") < F.col("y.id")))
    both, product = length("x") + length("y"), length("x") * length("y")
    out = both - 2 * common + 2 * common * (common * both / product - least)
    edits = F.greatest(out, both - 2 * least * product / both)
    meet = (F.col("x.block") == F.col("y.block")) & longer & (common * both >= least * product - 1e-6) & (F.col("x.block").bitwiseAND(F.lit(3)) == of_class)
    meet &= F.coalesce(F.levenshtein("x.text", "y.text") <= edits + 1e-6, F.lit(True))
    return x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def key_links(numbered: DataFrame, bar: float) -> DataFrame:
    """Links a, b of numbered keys (id, key; distinct) that span the components of those that score bar or more.

    Up to BROADCAST_KEYS keys of BROADCAST_CHARS characters go to the executors, so that pairs are scored where the index finds
    them, some of them twice; more keys are shuffled to the pairs, each of which is then scored once.
    """
    count, chars = numbered.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    few = count <= BROADCAST_KEYS and chars <= BROADCAST_CHARS
    near = near_keys(numbered, bar)
    near = near if few else near.distinct()

    def named(end: str) -> DataFrame:
        keys = numbered.select(F.col("id").alias(end), F.col("key").alias(f"key_{end}"))
        return F.broadcast(keys) if few else keys

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(k).to_pylist() for k in range(4))
            step = max(1, min(8192, SCORE_AT_ONCE // max(map(len, [*left, *right]), default=1)))
            keep = np.concatenate([np.zeros(0), *[jaro_winkler(left[k : k + step], right[k : k + step]) for k in range(0, len(a), step)]]) >= bar
            at = np.flatnonzero(keep)
            a, b = spanning([a[k] for k in at], [b[k] for k in at])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pairs = near.join(named("a"), "a").join(named("b"), "b").select("a", "b", "key_a", "key_b")
    return pairs.mapInArrow(score, "a long, b long")


def clusters(rows: DataFrame, thresholds: Thresholds = THRESHOLDS, bar: float | None = None) -> DataFrame:
    """mint, cluster (the smallest mint of its component), for rows of mint, normName, normSymbol and perhaps uri.

    Keys under the least length link nothing; records of one non-empty uri are linked; unmatched records stay alone.
    """
    bar = thresholds.narrative.min_similarity if bar is None else bar
    least = thresholds.narrative.min_length
    none = F.array().cast("array<string>")
    texts = F.filter(F.array("normName", "normSymbol"), lambda x: F.length(x) >= least)
    uris = F.when(F.coalesce(F.col("uri"), F.lit("")) != "", F.array(F.concat(F.lit("\u0000"), "uri"))).otherwise(none) if "uri" in rows.columns else none
    of = rows.select("mint", F.explode(F.array_distinct(F.concat(texts, uris))).alias("key"))
    numbered = settled(of.select("key").distinct().select(F.monotonically_increasing_id().alias("id"), "key"), "keys")
    of = settled(of.distinct().join(numbered, "key").select("mint", "id").withColumn("first", F.min("id").over(Window.partitionBy("mint"))), "keys-of")  # a window of a record's own keys
    edges = of.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    if bar < 1:
        edges = edges.union(key_links(numbered.where(~F.col("key").startswith("\u0000")), bar))
    roots = connected(edges)
    labels = of.where("id = first").join(roots, F.col("first") == F.col("node"), "left").select("mint", F.coalesce("root", "first").alias("root"))
    labels = settled(labels, "roots")
    named = labels.join(labels.groupBy("root").agg(F.min("mint").alias("cluster")), "root").select("mint", "cluster")
    return rows.select("mint").join(named, "mint", "left").select("mint", F.coalesce("cluster", "mint").alias("cluster"))


def largest_first(found: DataFrame, order: DataFrame) -> DataFrame:
    """cluster, n, first: clusters() rows by size, the largest first, ties by first appearance. order: mint, pos."""
    sizes = found.join(order, "mint").groupBy("cluster").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return sizes.orderBy(F.desc("n"), "first")
