"""Tables kept as a log: batches are written as they come, merged when read, and folded together when they have grown.

A table is a base of unique keys and a list of runs, newest last. A run holds what batches told of keys: values to merge in, or
that a key is deleted. Reading folds the runs to a row a key and merges these into the base, whose other rows pass through
unread by any shuffle. An append writes its own rows alone. Then, once the runs hold a RATIO-th of the base's rows (and at least
what is worth it, split_rows / FLOOR), they are merged into it; else, if there are more than RATIO of them, the newest that are
not a RATIO-th of the one before become one. So a row is rewritten about RATIO log(table / batch) times at most, and runs stay
few and a small share of what a read opens.

Base and runs lie in buckets by the low bits of a hash of the key. A bucket that would hold more than split_rows is written
as its two halves by one more bit, or more (extendible hashing); only buckets whose keys are told of are rewritten. A read for
a list of keys opens the buckets of those keys alone.

A commit is a numbered JSON file that names every bucket's folder (the directory), and the last epoch of each stream that was
merged in; it is made by a rename that fails where that number is taken, so readers see the old table or the new one, a
failed write leaves the old one in place, and of two writers that began from one version the later one is refused. Folders of
a refused or failed write are removed, as are those that none of the last KEPT commits names; what a lost driver left is
removed after ORPHAN_MS.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from echofold.model import COIN, COIN_TOLD, THRESHOLDS, Thresholds
from echofold.operators import merge

OWN_DIR = "echofold.shared.dir"  # remembers the folder chosen
KEPT, RATIO, SPLIT_ROWS, FLOOR, BROADCAST_ROWS, ORPHAN_MS = 8, 8, 1_000_000, 50, 500_000, 86_400_000


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where none is set: with a local master one of this
    machine, removed at exit; on a cluster a folder in the warehouse, refused if that is a file system of each machine."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not held and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = tempfile.mkdtemp(prefix="echofold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        held = f"file://{folder}"
    elif not held:
        held = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_echofold"
        if hadoop_path(spark, held)[1].getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set(OWN_DIR, held)
    return held


def settled(frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame written to the shared folder and read back, so what follows reads it rather than making it again. by: a
    column of whole numbers, a folder for each of which is written."""
    path = f"{shared_dir(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since the version that this write began from."""


@dataclass(frozen=True)
class Rules:
    """What a table's rows are, and how what runs tell of a key becomes one row of it.

    fold: rows of told, each with _seq (what was told later has more), to one a key; none is older than its key's last
    deletion. merge: base rows and folded rows, of any keys, to rows.
    """

    schema: str
    key: tuple[str, ...]
    told: str
    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame, DataFrame], DataFrame]


def columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class LogStore:
    """A table at a path. split_rows: the most rows of a bucket when written."""

    def __init__(self, spark: SparkSession, path: str, rules: Rules, split_rows: int = SPLIT_ROWS, ratio: int = RATIO):
        self.spark, self.path, self.rules, self.split_rows, self.ratio = spark, path.rstrip("/"), rules, split_rows, ratio
        self._commits = f"{self.path}/_commits"
        self._fs = hadoop_path(spark, self.path)[1]
        self._base: int | None = None
        self._known: dict[int, str] = {}
        self.opened = 0  # folders that the last read for a list of keys opened

    def _at(self, path: str):
        return hadoop_path(self.spark, path)[0]

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at(self._commits)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self._commits))]
        return sorted(int(x) for x in names if x.isdigit())

    def _commit(self, number: int) -> dict:
        if number not in self._known:  # a commit never changes
            source = self._fs.open(self._at(f"{self._commits}/{number:012d}"))
            self._known[number] = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            source.close()
        return json.loads(self._known[number])

    def state(self) -> tuple[int, dict]:
        """Number and content of the last commit."""
        numbers = self._numbers()
        return (numbers[-1], self._commit(numbers[-1])) if numbers else (-1, {"base": {}, "runs": [], "seq": 0, "epochs": {}, "note": {}})

    def version(self) -> str | None:
        number, _ = self.state()
        return None if number < 0 else str(number)

    def epoch(self, query: str) -> int:
        """The last epoch of a stream that was merged in, -1 if none was."""
        return int(self.state()[1]["epochs"].get(query, -1))

    # --- reading -------------------------------------------------------------------------------------------------------

    def _rows(self, leaves: list[dict], schema: str) -> DataFrame:
        folders = [f"{self.path}/{x['folder']}" for x in leaves if x["folder"]]
        if folders:
            return self.spark.read.schema(schema).parquet(*folders)
        nothing = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split(" ", 1) for x in schema.split(", ")))
        return self.spark.sql(f"SELECT {nothing} WHERE FALSE")  # which plans drop, unlike an empty list of rows

    def _folded(self, runs: list[dict], only: Callable[[dict], list[dict]] = lambda part: list(part.values())) -> DataFrame:
        rows = self._rows([x for run in runs for x in only(run["leaves"])], f"{self.rules.told}, _seq long")
        key = list(self.rules.key)
        if any(run["deletes"] for run in runs):
            last = rows.where("deleted").groupBy(*key).agg(F.max("_seq").alias("_last"))
            rows = rows.join(last, key, "left").where("_last IS NULL OR _seq >= _last").drop("_last")
        return self.rules.fold(rows)

    def _merged(self, base: DataFrame, told: DataFrame, most: int) -> DataFrame:
        """base with folded rows, at most so many, merged in."""
        if most > BROADCAST_ROWS:
            return self.rules.merge(base, told)
        key = list(self.rules.key)
        keys = F.broadcast(told.select(*key))
        return base.join(keys, key, "left_anti").unionByName(self.rules.merge(base.join(keys, key, "left_semi"), told))

    def _whole(self, commit: dict) -> DataFrame:
        base = self._rows(list(commit["base"].values()), self.rules.schema)
        runs = commit["runs"]
        return self._merged(base, self._folded(runs), sum(r["rows"] for r in runs)) if runs else base

    def read(self) -> DataFrame:
        """The current rows; an unwritten store has none. What is written next is held to begin from here."""
        self._base, commit = self.state()
        return self._whole(commit)

    def read_keys(self, keys: DataFrame, held: bool = False) -> DataFrame:
        """The current rows of some keys (columns of that name), from their buckets alone. held: keys are distinct and in the
        shared folder already. Their files tell Spark whether they are few enough to be broadcast."""
        commit, key = self.state()[1], list(self.rules.key)
        keys = keys.select(*key) if held else settled(keys.select(*key).distinct(), "keys")
        parts = [commit["base"], *(r["leaves"] for r in commit["runs"])]
        deepest = max((_depth(name)[0] for part in parts for name in part), default=0)
        slots = {r.s for r in keys.select(self._slot(deepest).alias("s")).distinct().collect()} if deepest else {0}  # as many as buckets at most
        shallow = {d: {s % (1 << d) for s in slots} for d in range(deepest + 1)}
        wanted = lambda part: [x for name, x in part.items() if _depth(name)[1] in shallow[_depth(name)[0]]]
        self.opened = sum(bool(x["folder"]) for part in parts for x in wanted(part))
        base = self._rows(wanted(commit["base"]), self.rules.schema).join(keys, key, "left_semi")
        return self.rules.merge(base, self._folded(commit["runs"], wanted).join(keys, key, "left_semi")) if commit["runs"] else base

    # --- writing -------------------------------------------------------------------------------------------------------

    def _slot(self, depth: int) -> Column:
        return F.pmod(F.xxhash64(*self.rules.key), F.lit(1 << depth)).cast("int") if self.rules.key else F.lit(0)

    def _placed(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """rows with the bucket of each, of a directory's names, as _bucket."""
        deepest = max(_depth(x)[0] for x in names)
        if not deepest:
            return rows.withColumn("_bucket", F.lit("0-0"))
        every = [(low + (k << d), name) for name in names for d, low in [_depth(name)] for k in range(1 << (deepest - d))]
        directory = self.spark.createDataFrame(every, "_slot int, _bucket string")  # a row for each bucket of the greatest depth
        return rows.withColumn("_slot", self._slot(deepest)).join(F.broadcast(directory), "_slot").drop("_slot")

    def _write(self, rows: DataFrame, names: list[str]) -> tuple[str, dict]:
        """A new folder of the rows in buckets of those names, and their leaves of the directory."""
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.path}/{version}"
        try:
            if len(names) == 1:
                told = Observation()
                rows.observe(told, F.count(F.lit(1)).alias("rows")).write.parquet(f"{at}/_bucket={names[0]}")
                count = {names[0]: told.get["rows"]}
            else:
                tasks = max(len(names), self._tasks())  # few buckets are each written by several tasks
                share = F.pmod(F.xxhash64(F.lit(0), *self.rules.key), F.lit(-(-tasks // len(names))))
                self._placed(rows, names).repartition(tasks, "_bucket", share).write.partitionBy("_bucket").parquet(at)
                count = {r["_bucket"]: r["count"] for r in self.spark.read.schema("_bucket string").parquet(at).groupBy("_bucket").count().collect()}
        except Exception:
            self._fs.delete(self._at(at), True)
            raise
        return version, {x: {"folder": f"{version}/_bucket={x}" if count.get(x) else None, "rows": count.get(x, 0)} for x in names}

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _split(self, name: str, rows: int) -> list[str]:
        """The buckets that so many rows of a bucket go to."""
        depth, low = _depth(name)
        more = 0
        while rows > self.split_rows << more and self.rules.key:
            more += 1
        return [f"{depth + more}-{low + (k << depth)}" for k in range(1 << more)]

    def replace(self, rows: DataFrame) -> None:
        """Writes all rows anew; they may derive from those last read."""
        number, commit = self._begun()
        version, leaves = self._write(rows.select(*[c for c in columns(self.rules.schema) if c in rows.columns]), self._split("0-0", rows.count()))
        self._publish(number + 1, commit | {"base": leaves, "runs": [], "seq": commit["seq"] + 1}, version)

    def seq(self) -> int:
        """Grows with each write that can change rows; compaction leaves it."""
        return self.state()[1]["seq"]

    def append(self, told: DataFrame, epoch: tuple[str, int] | None = None, deletes: bool = False, note: dict | None = None) -> None:
        """Adds a run. epoch: the stream and its batch, added once. deletes: whether some rows say so. note: kept in the commit."""
        number, commit = self._begun()
        if epoch and int(commit["epochs"].get(epoch[0], -1)) >= epoch[1]:
            return
        seq = commit["seq"] + 1
        fields = [x.split() for x in self.rules.told.split(", ")]
        told = told.select(*[F.col(c) if c in told.columns else F.lit(None).cast(kind).alias(c) for c, kind in fields], F.lit(seq).cast("long").alias("_seq"))
        version, leaves = self._write(told, ["0-0"])
        rows = leaves["0-0"]["rows"]
        runs = commit["runs"] + ([{"seq": seq, "rows": rows, "deletes": deletes, "leaves": leaves}] if rows else [])
        new = commit | {"runs": runs, "seq": seq, "epochs": commit["epochs"] | ({epoch[0]: epoch[1]} if epoch else {}), "note": commit.get("note", {}) | (note or {})}
        self._publish(number + 1, new, version)
        try:
            self._compact(number + 1, new)
        except ConcurrentWrite:  # another writer's commit has come first; a later one will compact
            self._base = None

    def _begun(self) -> tuple[int, dict]:
        """The version that a write begins from."""
        number, commit = self.state()
        if self._base is None or self._base == number:
            return number, commit
        raise ConcurrentWrite(f"{self.path}: version {number} has followed {self._base}")

    def _compact(self, number: int, commit: dict) -> None:
        runs, base = commit["runs"], sum(x["rows"] for x in commit["base"].values())
        told = sum(r["rows"] for r in runs)
        if not told:
            return
        if told * self.ratio >= base and told * FLOOR >= self.split_rows:
            names = list(commit["base"]) or ["0-0"]
            folded = settled(self._folded(runs), "told")
            if len(names) == 1:
                count = {names[0]: told}
            else:
                count = {r["_bucket"]: r["count"] for r in self._placed(folded.select(*self.rules.key), names).groupBy("_bucket").count().collect()}
            rows = self._merged(self._rows([x for n, x in commit["base"].items() if n in count], self.rules.schema), folded, told)
            split = {n: self._split(n, commit["base"].get(n, {"rows": 0})["rows"] + k) for n, k in count.items()}
            version, leaves = self._write(rows.select(*columns(self.rules.schema)), [x for n in names for x in split.get(n, [n])])
            kept = {n: x for n, x in commit["base"].items() if n not in count}
            self._publish(number + 1, commit | {"base": {n: kept.get(n, x) for n, x in leaves.items()}, "runs": []}, version)
            return
        if len(runs) <= self.ratio:
            return
        first = len(runs) - 1
        while first and runs[first - 1]["rows"] < self.ratio * sum(r["rows"] for r in runs[first:]):
            first -= 1
        if first == len(runs) - 1:
            return
        own, last = runs[first:], runs[-1]["seq"]
        rows = self._folded(own).withColumn("_seq", F.lit(last).cast("long"))
        version, leaves = self._write(rows, self._split("0-0", sum(r["rows"] for r in own)))
        one = {"seq": last, "rows": sum(x["rows"] for x in leaves.values()), "deletes": any(r["deletes"] for r in own), "leaves": leaves}
        self._publish(number + 1, commit | {"runs": [*runs[:first], one]}, version)

    def _publish(self, number: int, commit: dict, version: str) -> None:
        held, at = self._at(f"{self.path}/_next-{uuid.uuid4().hex}"), self._at(f"{self._commits}/{number:012d}")
        out = self._fs.create(held, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        self._fs.mkdirs(self._at(self._commits))
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(held, at, options)
        except Exception as e:
            self._fs.delete(held, False)
            self._fs.delete(self._at(f"{self.path}/{version}"), True)
            if self._fs.exists(at):
                raise ConcurrentWrite(f"{self.path}: commit {number} is taken") from e
            raise
        self._base = number
        self._tidy()

    def _tidy(self) -> None:
        numbers = self._numbers()
        folders = lambda commit: {x["folder"].partition("/")[0] for part in (commit["base"], *(r["leaves"] for r in commit["runs"])) for x in part.values() if x["folder"]}
        named = set().union(*[folders(self._commit(n)) for n in numbers[-KEPT:]])
        gone = set().union(*[folders(self._commit(n)) for n in numbers[:-KEPT]]) - named
        old = int(time.time() * 1000) - ORPHAN_MS
        gone |= {s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith("v-") and s.getModificationTime() < old} - named
        for version in gone:
            self._fs.delete(self._at(f"{self.path}/{version}"), True)
        for n in numbers[:-KEPT]:
            self._known.pop(n, None)
            self._fs.delete(self._at(f"{self._commits}/{n:012d}"), False)


def _depth(name: str) -> tuple[int, int]:
    """The number of bits of a bucket's name, and the bits."""
    depth, _, low = name.partition("-")
    return int(depth), int(low)


class OneRow(LogStore):
    """A table that is only ever replaced, as it has no key."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(spark, path, Rules(schema, (), schema, lambda rows: rows, lambda base, told: told))


class CoinStore(LogStore):
    """Records by mint. Sightings, hash verdicts and removals are told; ran is as the thresholds at hand have it."""

    def __init__(self, spark: SparkSession, path: str, thresholds: Thresholds = THRESHOLDS, split_rows: int = SPLIT_ROWS, ratio: int = RATIO):
        super().__init__(spark, path, Rules(COIN, ("mint",), COIN_TOLD, merge.told_once, lambda base, told: merge.with_told(base, told, thresholds)), split_rows, ratio)
        self.thresholds = thresholds

    def _whole(self, commit: dict) -> DataFrame:
        return self._judged(super()._whole(commit))

    def read_keys(self, keys: DataFrame, held: bool = False) -> DataFrame:
        return self._judged(super().read_keys(keys, held))

    def _judged(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("ran", merge.did_run(F.col("peakMcUsd"), F.col("sawMigrated"), self.thresholds))

    def merge(self, batch: DataFrame, epoch: tuple[str, int] | None = None) -> None:
        """Adds sightings, folded to a row a key, whatever has been committed since the last read."""
        self._base = None
        self.append(batch, epoch)

    def tell_hashes(self, verdicts: DataFrame) -> None:
        """Verdicts (mint, phash, phashState) of known mints, over those before."""
        self.append(verdicts.withColumn("hashed", F.lit(True)))

    def remove(self, mints: DataFrame) -> None:
        self.append(mints.select("mint", F.lit(True).alias("deleted")), deletes=True)
