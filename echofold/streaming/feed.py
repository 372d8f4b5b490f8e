"""Streams of launches and sightings: file landing, fold by micro-batch into the store, stateful fold, bounded dedupe, alarms."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echofold.functions.parse import BASE58
from echofold.model import LAUNCH, OBSERVATION
from echofold.operators.merge import folded
from echofold.sources.store import CoinStore, settled

#: Keys remembered, silence before an alarm, and the rate under which a long-running feed is suspect.
SEEN_CAP, SILENCE_MS, RATE_AFTER_MS, LEAST_A_MINUTE = 20_000, 60_000, 300_000, 10
#: Rows that a task of a bounded dedupe walks, and the marks of what is remembered: the generation before, and the one that fills.
STEP_ROWS, LAST, NOW = 500_000, 1, 2
#: Fixed value: time between reports of what a feed has read.
REPORT_MS = 30_000
#: The longest wait before each further attempt to reconnect; the last holds for all later ones.
WAITS_MS = [min(30_000, 500 << k) for k in range(7)]


def launches(spark: SparkSession, path: str) -> DataFrame:
    """The stream of created launches with a whole address that land as JSON lines in a folder; other frames are passed over."""
    rows = spark.readStream.schema(LAUNCH + ", txType string, message string").json(path)
    return rows.where((F.col("txType") == "create") & F.col("message").isNull() & F.col("mint").rlike(BASE58)).drop("txType", "message")


def sightings(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(OBSERVATION + ", seq long").json(path)


def fold_into(stream: DataFrame, store: CoinStore, checkpoint: str, trigger: dict | None = None):
    """Merges each micro-batch into the store. One batch at a time; the commit that holds a batch names its query and
    epoch, so a batch that is run again, after a restart too, is merged once, and queries on one store don't mix.

    The trigger (250 ms by default) coalesces bursts: what arrives while a batch runs waits for the next.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        store.merge(folded(batch), (query, epoch))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


TEXTS = ["name", "symbol", "imageUrl"]
FOLD_STATE = ", ".join(f"{c} string, {c}Seq long" for c in TEXTS) + ", firstSeen long, lastSeen long, peakMcUsd double, peakVolUsd double, sawMigrated boolean, sightings long"
FOLD_OUT = "mint string, name string, symbol string, imageUrl string, firstSeen long, lastSeen long, peakMcUsd double, peakVolUsd double, sawMigrated boolean, sightings long"


def stateful_fold(stream: DataFrame) -> DataFrame:
    """The same fold as a keyed state: emits each touched key's record after a micro-batch (update mode). Rows are folded
    by Spark's partial aggregates in fold_into(); this form is for sinks that want the changed records alone."""
    fields, out = ([x.split()[0] for x in y.split(", ")] for y in (FOLD_STATE, FOLD_OUT))
    known = lambda values: [x for x in values if not pd.isna(x)]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(fields, state.get, strict=True)) if state.exists else dict.fromkeys(fields) | {"sawMigrated": False, "sightings": 0}
        for rows in parts:
            row = {c: rows[c].tolist() for c in (*TEXTS, "seq", "seenAt", "marketCapUsd", "volumeUsd", "source")}
            for c, use, values in (("firstSeen", min, row["seenAt"]), ("lastSeen", max, row["seenAt"]), ("peakMcUsd", max, row["marketCapUsd"]), ("peakVolUsd", max, row["volumeUsd"])):
                held[c] = use(known([held[c], *values]), default=None)
            for c in TEXTS:
                texts = [(seq, x) for seq, x in ((held[c + "Seq"], held[c]), *zip(row["seq"], row[c], strict=True)) if not pd.isna(x)]
                held[c + "Seq"], held[c] = min(texts, key=lambda t: t[0], default=(None, None))
            held["sawMigrated"] = bool(held["sawMigrated"]) or "migrated" in row["source"]
            held["sightings"] = int(held["sightings"]) + len(rows)
        for c in fields:
            if pd.isna(held[c]):
                held[c] = None
            elif c in ("firstSeen", "lastSeen") or c.endswith("Seq"):
                held[c] = int(held[c])
        state.update(tuple(held[f] for f in fields))
        yield pd.DataFrame([{"mint": key[0]} | held], dtype=object)[out]

    return stream.groupBy("mint").applyInPandasWithState(step, FOLD_OUT, FOLD_STATE, "update", GroupStateTimeout.NoTimeout)


class BoundedSeen:
    """Keys in order of arrival, at most an even number, cap. Past the cap the older half is forgotten; a key that comes again
    keeps its place. As what is forgotten is always half a cap of admissions, keys fall into generations of that many: while one
    fills, its keys and those of the one before are remembered, and no others.

    What is remembered at a row depends on each admission before it, so rows are walked in order. add() cuts a table of arrivals
    by ranges of their order into steps of STEP_ROWS rows or so; each step is one task's, which passes through as many
    generations as its rows fill, and begins with the two tables of half a cap each that the step before has left.
    """

    def __init__(self, spark: SparkSession, cap: int = SEEN_CAP, key: str = "mint", held: tuple[DataFrame, DataFrame] | None = None):
        if cap < 2 or cap % 2:
            raise ValueError("the cap is an even number")
        self.half, self.key = cap // 2, key
        nothing = spark.range(0).select(F.col("id").cast("string").alias(key))
        self.last, self.now = held or (nothing, nothing)

    def add(self, rows: DataFrame, pos: str) -> DataFrame:
        """The rows that are admitted; pos, their order, differs for each. Their keys are remembered."""
        rows, out = settled(rows.where(F.col(self.key).isNotNull()), "arrivals"), []
        steps = max(1, -(-rows.count() // STEP_ROWS))
        if steps > 1:
            rows = settled(rows.repartitionByRange(steps, pos).withColumn("_step", F.spark_partition_id()), "steps", "_step")
        schema = rows.drop("_step").withColumn("_held", F.lit(0)).schema
        for step in range(steps):
            own = (rows.where(F.col("_step") == step).drop("_step") if steps > 1 else rows).withColumn("_held", F.lit(0))
            told = own.unionByName(self._told(), allowMissingColumns=True).coalesce(1).sortWithinPartitions(F.desc("_held"), pos)
            found = settled(told.mapInArrow(partial(walked, self.half, self.key), schema), "admitted")
            out.append(found.where("_held = 0").drop("_held"))
            self.last, self.now = (found.where(F.col("_held") == k).select(self.key) for k in (LAST, NOW))
        return reduce(DataFrame.union, out)

    def _told(self) -> DataFrame:
        return self.last.withColumn("_held", F.lit(LAST)).union(self.now.withColumn("_held", F.lit(NOW)))


def walked(half: int, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, behind those that tell what is remembered (_held): the ones admitted, then what is remembered after them."""
    last, now, schema = set(), set(), None
    for batch in batches:
        schema, admitted = batch.schema, []
        for k, (x, held) in enumerate(zip(batch[key].to_pylist(), batch["_held"].to_pylist(), strict=True)):
            if held:
                (last if held == LAST else now).add(x)
            elif x not in now and x not in last:
                if len(now) == half:
                    last, now = now, set()
                now.add(x)
                admitted.append(k)
        yield batch.take(pa.array(admitted, pa.int64()))
    if schema is not None:
        told = {key: pa.array([*last, *now], schema.field(key).type), "_held": pa.array([LAST] * len(last) + [NOW] * len(now), pa.int32())}
        yield pa.RecordBatch.from_arrays([told.get(f.name, pa.nulls(len(last) + len(now), f.type)) for f in schema], schema=schema)


def dedupe_into(stream: DataFrame, path: str, checkpoint: str, pos: str, cap: int = SEEN_CAP, key: str = "mint", trigger: dict | None = None):
    """Writes the stream's rows whose key is not among those remembered to path/rows, each micro-batch to a folder of its own
    with what is remembered after it, so that a batch that is run again replaces what it wrote. pos: a column by which a
    micro-batch's rows are ordered."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = None
        if epoch:
            before = spark.read.schema(f"{key} string, now boolean").parquet(f"{path}/seen/epoch={epoch - 1}")
            held = (before.where("NOT now").select(key), before.where("now").select(key))
        seen = BoundedSeen(spark, cap, key, held)
        seen.add(batch, pos).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        told = seen.last.withColumn("now", F.lit(False)).union(seen.now.withColumn("now", F.lit(True)))
        told.write.mode("overwrite").parquet(f"{path}/seen/epoch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


def backoff_ms(attempt: int, waits: list[int] = WAITS_MS, draw=random.random) -> int:
    """A random wait between the shortest one and that of the attempt."""
    return int(np.interp(draw(), [0, 1], [waits[0], waits[min(attempt, len(waits) - 1)]]))


def silences(rows: DataFrame, feed: str, at: str, id: str, silence_ms: int = SILENCE_MS, bucket_ms: int = 86_400_000) -> DataFrame:
    """A row for each stretch of a feed without anything for silence_ms or more: feed, attempt (from 1, never reset),
    last_heard, heard_again, silent_ms, heard (rows since the silence before), wait_least and wait_most of backoff_ms().

    Rows of a feed fall into islands between silences; an island is numbered by the silences before it. Windows run over a feed's
    buckets of bucket_ms, and over a row a bucket, so a feed with many rows is many tasks.
    """
    own = rows.select(feed, at, id, F.floor(F.col(at) / bucket_ms).alias("bucket"))
    key, by = [feed, "bucket"], Window.partitionBy(feed).orderBy("bucket")
    order = Window.partitionBy(*key).orderBy(at, id)
    ends = own.groupBy(*key).agg(F.max(at).alias("last")).withColumn("ended", F.lag("last").over(by)).drop("last")
    told = own.withColumn("here", F.lag(at).over(order)).join(ends, key).withColumn("before", F.coalesce("here", "ended"))
    told = told.withColumn("breaks", F.coalesce(F.col(at) - F.col("before") >= silence_ms, F.lit(False)).cast("long"))
    earlier = told.groupBy(*key).agg(F.sum("breaks").alias("breaks")).select(*key, F.coalesce(F.sum("breaks").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("broken"))
    told = told.withColumn("sofar", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(earlier, key).withColumn("attempt", F.col("broken") + F.col("sofar"))
    islands = told.groupBy(feed, "attempt").agg(F.count("*").alias("heard"), F.min_by(F.struct(at, "before"), F.struct(at, id)).alias("first"))
    before = Window.partitionBy(feed).orderBy("attempt")
    islands = islands.withColumn("heard", F.lag("heard").over(before)).where("attempt > 0")
    most = F.least(F.lit(WAITS_MS[-1]), F.lit(WAITS_MS[0]) * F.pow(F.lit(2), F.least("attempt", F.lit(len(WAITS_MS))))).cast("long")
    return islands.select(
        feed, "attempt", F.col("first.before").alias("last_heard"), F.col(f"first.{at}").alias("heard_again"), (F.col(f"first.{at}") - F.col("first.before")).alias("silent_ms"), "heard",
        F.lit(WAITS_MS[0]).cast("long").alias("wait_least"), most.alias("wait_most"),
    )


def rate_alarm(launched: int | Column, running_ms: int | Column) -> bool | Column:
    """A feed that has run for over five minutes with under ten launches a minute; numbers or columns."""
    return (running_ms > RATE_AFTER_MS) & (launched * 60_000 < running_ms * LEAST_A_MINUTE)


class Watchdog(StreamingQueryListener):
    """Calls on_silence when a query's progress shows no rows for silence_ms; any row resets it."""

    def __init__(self, on_silence, silence_ms: int = SILENCE_MS):
        self.on_silence, self.silence_ms, self.last = on_silence, silence_ms, None

    def note(self, now_ms: int, rows: int) -> None:
        if rows or self.last is None:
            self.last = now_ms
        elif now_ms - self.last >= self.silence_ms:
            self.last = now_ms
            self.on_silence()

    def onQueryStarted(self, event):
        self.last = None

    def onQueryProgress(self, event):
        at = pd.Timestamp(event.progress.timestamp).value // 1_000_000
        self.note(at, event.progress.numInputRows)

    def onQueryIdle(self, event):
        self.note(pd.Timestamp(event.timestamp).value // 1_000_000, 0)

    def onQueryTerminated(self, event):
        pass


class Report(StreamingQueryListener):
    """Calls say(rows, total) with the rows since its last call and since the start, at most once in every_ms."""

    def __init__(self, say, every_ms: int = REPORT_MS):
        self.say, self.every_ms, self.last, self.rows, self.total = say, every_ms, None, 0, 0

    def note(self, now_ms: int, rows: int) -> None:
        self.rows, self.total = self.rows + rows, self.total + rows
        if self.last is None:
            self.last = now_ms
        elif now_ms - self.last >= self.every_ms:
            self.say(self.rows, self.total)
            self.last, self.rows = now_ms, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.note(pd.Timestamp(event.progress.timestamp).value // 1_000_000, event.progress.numInputRows)

    def onQueryIdle(self, event):
        self.note(pd.Timestamp(event.timestamp).value // 1_000_000, 0)

    def onQueryTerminated(self, event):
        pass
