"""Which events fire, where an event that fires holds its key for a while and those that come meanwhile are dropped.

A pass over a feed is armed by its first change and takes in all others of 250 ms; a sweep that runs lets no other begin. Both
are chains: an event that fires points at the first of its key at or after its end, which fires next. Chains are followed by
pointer doubling: each round, all events known to fire mark those that they point at, and all pointers are replaced by pointers
twice as far, so the rounds go with the logarithm of the longest chain. An event that begins after every earlier one of its key
has ended fires in any case, so chains are as long as unbroken stretches alone.

Pointers come from running windows over a key's time buckets, so a key with many events is many tasks: within a bucket, the
events and the ends that fall into it in one order; past a bucket, from a row a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.sources.store import settled

#: Fixed value: how long a first change waits for others.
COALESCE_MS = 250
BUCKET_MS = 3_600_000


def pointers(events: DataFrame, bucket_ms: int) -> DataFrame:
    """events (id, key, at, until) with next, the id of the first of the key at or after until, and free: whether all earlier ones had ended."""
    bucket = lambda t: F.floor(F.col(t) / bucket_ms).cast("long")
    null = F.lit(None)
    order = F.struct("at", "id")
    own = events.select("key", bucket("at").alias("b"), "at", "id", "until", F.lit(0).alias("end"))
    ends = events.select("key", bucket("until").alias("b"), F.col("until").alias("at"), "id", null.cast("long").alias("until"), F.lit(1).alias("end"))
    both = own.unionByName(ends)
    # a row a bucket: its first event, and the latest end of the events in it
    rows = both.groupBy("key", "b").agg(F.min(F.when(F.col("end") == 0, order)).alias("first"), F.max("until").alias("most"))
    by = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("key").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("key", "b", F.max("most").over(by).alias("ended"), F.last("first", True).over(down).alias("later"))
    # in a bucket, from its end backwards: the last event that was seen is the first one not before an end
    back = Window.partitionBy("key", "b").orderBy(F.desc("at"), "end", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy("key", "b").orderBy("at", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("here", F.last(F.when(F.col("end") == 0, F.col("id")), True).over(back)).withColumn("running", F.max("until").over(forth))
    seen = seen.join(rows, ["key", "b"])
    free = seen.where("end = 0").select("id", F.coalesce(F.col("at") >= F.greatest("running", "ended"), F.lit(True)).alias("free"))
    following = seen.where("end = 1").select("id", F.coalesce("here", F.col("later.id")).alias("next"))
    return free.join(following, "id")


def fires(events: DataFrame, holds_ms, key: str, at: str, id: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """id of the events that fire. at: milliseconds; id: different for each event, and the order of events of one time.
    holds_ms: a number or a column, null or under 1 as 1. Events without a key or time fire nothing and hold nothing."""
    holds = F.greatest(F.coalesce(F.lit(holds_ms) if isinstance(holds_ms, int) else holds_ms, F.lit(1)).cast("long"), F.lit(1).cast("long"))
    rows = events.select(events[id].alias("id"), events[key].alias("key"), events[at].cast("long").alias("at"), (events[at].cast("long") + holds).alias("until")).where("key IS NOT NULL AND at IS NOT NULL")
    found = settled(pointers(rows, bucket_ms), "pointers")
    fired, count = found.where("free").select("id"), 0
    jumps = found.where("next IS NOT NULL").select("id", "next")
    while True:
        fired = settled(fired.union(jumps.join(fired, "id").select(F.col("next").alias("id"))).distinct(), "fired")
        before, count = count, fired.count()
        if count == before:
            return fired.withColumnRenamed("id", id)
        far = jumps.select(F.col("id").alias("next"), F.col("next").alias("far"))
        jumps = settled(jumps.join(far, "next").select("id", F.col("far").alias("next")), "jumps")
