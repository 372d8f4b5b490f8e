"""The lookup index as stored data: for each (kind, key) its first mints and their number, kept up by differences.

A posting holds the first cap + 1 mints of its bucket in binary order, which is all that a capped lookup can use, and the
number of all. A write to the records changes the postings of keys that its records gained or lost, and no others: what came
is merged into the list, what went is taken out of it. A list that was not all of its bucket and lost a mint can lack the next
ones; such lists alone are read anew from the records. The index is a log like the records, with one run a write, and lookups
open the buckets of the keys that they probe.

The commit of a run names the version of the records that it follows; an index that follows another one is built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.model import THRESHOLDS, Thresholds
from echofold.operators.candidates import SAME_KEYS, counted_postings, differences, first_of, from_postings, postings, probes
from echofold.sources.store import BROADCAST_ROWS, RATIO, SPLIT_ROWS, CoinStore, LogStore, Rules, settled

POSTING, BUCKET = "kind string, key string, mints array<string>, n long", ["kind", "key"]


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BUCKET).agg(F.max_by(F.struct("mints", "n"), "_seq").alias("p")).select(*BUCKET, "p.mints", "p.n")


def _replaced(base: DataFrame, told: DataFrame) -> DataFrame:
    return base.join(told.select(*BUCKET), BUCKET, "left_anti").unionByName(told.where("n > 0"))


class PostingIndex:
    """The index of a store's records. cap: the most candidates that a lookup asks for."""

    def __init__(self, store: CoinStore, cap: int = THRESHOLDS.max_candidates, split_rows: int = SPLIT_ROWS, ratio: int = RATIO):
        self.store, self.cap = store, cap
        self.table = LogStore(store.spark, store.path + "-index", Rules(POSTING, tuple(BUCKET), POSTING, _last, _replaced), split_rows, ratio)

    def follows(self) -> int | None:
        """The version of the records that the index is of."""
        return self.table.state()[1]["note"].get("of")

    def rebuild(self) -> None:
        seq = self.store.seq()
        self.table._base = None
        self.table.replace(counted_postings(self.store.read(), self.cap + 1))
        self.table.append(self.table.read().limit(0), note={"of": seq})

    def around(self, mints: DataFrame, write) -> None:
        """Runs write(), which changes records of these mints alone, and follows it."""
        mints = settled(mints.select("mint").distinct(), "touched")
        known = self.follows() == self.store.seq()
        before = settled(self.store.read_keys(mints, held=True), "before") if known else None
        write()
        if known:
            self.change(before, settled(self.store.read_keys(mints, held=True), "after"))
        else:
            self.rebuild()

    def change(self, before: DataFrame, after: DataFrame) -> None:
        """Follows records that were as before and are as after. Of records that had and have the same keys one is counted for
        all, and the first cap + 1 are listed: the others are in no list."""
        keep, own = self.cap + 1, ["before", "after"]
        side = lambda rows, name: rows.select("mint", F.struct(*SAME_KEYS).alias(name))
        moved = side(before, "before").join(side(after, "after"), "mint", "full_outer").where("NOT before <=> after")
        moved = settled(moved, "moved")
        alike = settled(moved.groupBy(*own).agg(F.min("mint").alias("mint"), F.count("*").alias("alike")), "alike")
        change = settled(differences(alike).join(alike.select("mint", "alike"), "mint"), "index-change")
        net = settled(change.groupBy(*BUCKET).agg(F.sum(F.col("sign") * F.col("alike")).alias("net")), "net")
        old = settled(self.table.read_keys(net, held=True), "postings").withColumn("whole", F.col("n") == F.size("mints"))
        listed = old.select(*BUCKET, F.explode("mints").alias("mint"))
        gone = differences(moved.where("before IS NOT NULL").join(listed.select("mint").distinct(), "mint", "left_semi")).where("sign < 0")
        stays = listed.join(gone, [*BUCKET, "mint"], "left_anti")
        some = first_of(moved, own, keep).select(F.min("mint").over(Window.partitionBy(*own)).alias("_one"), F.col("mint").alias("_mint"))
        came = change.where("sign > 0").join(some, F.col("mint") == F.col("_one")).select(*BUCKET, F.col("_mint").alias("mint"))
        came = first_of(came, BUCKET, keep)
        # beyond the last mint of a list that is not the whole bucket there can be others, unlisted
        ends = old.where("NOT whole").select(*BUCKET, F.element_at("mints", -1).alias("end"))
        came = came.join(ends, BUCKET, "left").where("end IS NULL OR mint < end").drop("end")
        rows = first_of(stays.unionByName(came), BUCKET, keep)
        lists = rows.groupBy(*BUCKET).agg(F.array_sort(F.collect_list("mint")).alias("mints"))
        new = net.join(old.select(*BUCKET, "n"), BUCKET, "left").join(lists, BUCKET, "left")
        new = new.select(*BUCKET, F.coalesce("mints", F.array().cast("array<string>")).alias("mints"), (F.coalesce("n", F.lit(0)) + F.col("net")).alias("n"))
        new = settled(new, "new-postings")
        short = new.where(F.size("mints") < F.least(F.col("n"), F.lit(keep))).select(*BUCKET)
        few = short.count()
        if few:
            full = postings(self.store.read(), keep, F.broadcast(short) if few <= BROADCAST_ROWS else short).withColumnRenamed("mints", "all")
            new = new.join(full, BUCKET, "left").withColumn("mints", F.coalesce("all", "mints")).drop("all")
        self.table._base = None
        self.table.append(new, note={"of": self.store.seq()})

    def candidates(self, subjects: DataFrame, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
        """As operators.candidates.candidates(), from the stored postings of the subjects' keys."""
        if thresholds.max_candidates > self.cap:
            raise ValueError(f"the index holds {self.cap} candidates, {thresholds.max_candidates} are asked for")
        if self.follows() != self.store.seq():
            self.rebuild()
        asked = settled(probes(subjects, thresholds), "probes")
        return from_postings(asked, self.table.read_keys(asked), thresholds)
