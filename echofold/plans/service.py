"""The requests that a client makes, over a store and its index: observe, look up, describe, import, maintain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.model import META, THRESHOLDS, Thresholds
from echofold.operators import lookup as look
from echofold.operators import maintain, merge
from echofold.sources import launches
from echofold.sources.postings import PostingIndex
from echofold.sources.store import CoinStore, OneRow, settled


class Service:
    """Each request reads the current version; each write appends what it tells of the records, and its index follows.
    startedAt is kept beside the records and never moves."""

    def __init__(self, store: CoinStore, thresholds: Thresholds = THRESHOLDS):
        self.store, self.thresholds, self.spark = store, thresholds, store.spark
        self.index = PostingIndex(store, thresholds.max_candidates)
        self.started = OneRow(store.spark, store.path + "-started", META)

    def _start(self, now: int) -> None:
        if self.started.version() is None:
            self.started.replace(self.spark.createDataFrame([(now, 1, 0)], META))

    def _merge(self, batch: DataFrame) -> DataFrame:
        batch = settled(batch, "batch")
        self.index.around(batch, lambda: self.store.merge(batch))
        return batch

    def observe(self, observations: DataFrame, now: int, seq: str = "seq") -> DataFrame:
        """Merges sightings; returns their records."""
        self._start(now)
        return self.store.read_keys(self._merge(merge.folded(observations, seq)), held=True)

    def meta(self, now: int) -> DataFrame:
        """One row: startedAt, schemaVersion, coinCount, ageMs, badgesReady."""
        started = self.started.read().first()
        found = maintain.meta(self.store.read(), started.startedAt if started else 0)
        age = look.corpus_age(F.col("startedAt"), F.lit(now).cast("long"))
        return found.withColumn("ageMs", age).withColumn("badgesReady", look.is_confident(F.col("ageMs"), self.thresholds))

    def lookup(self, subjects: DataFrame, now: int) -> DataFrame:
        """One row per subject (mint, name, symbol); opens the buckets of the subjects' keys and of the records found."""
        own = settled(look.subjects_of(subjects, self.store.read_keys(subjects), self.thresholds), "subjects")
        found = settled(self.index.candidates(own, self.thresholds), "candidates")
        coins = self.store.read_keys(found.select(F.explode("mints").alias("mint")))
        started = self.started.read().first()
        return look.lookup(own, coins, started.startedAt if started else 0, now, self.thresholds, found)

    def import_launches(self, rows: DataFrame, now: int) -> DataFrame:
        """Merges checked launches; one row: written, added."""
        self._start(now)
        batch = settled(launches.import_batch(rows, now), "imported")
        known = self.store.read_keys(batch, held=True).count()
        counts = [(batch.agg(F.sum("sightings")).first()[0] or 0, batch.count() - known)]
        self._merge(batch)
        return self.spark.createDataFrame(counts, "written long, added long")

    def record_hashes(self, verdicts: DataFrame) -> int:
        """Writes verdicts (mint, phash, state) over; those of unknown mints create nothing. Returns how many were written."""
        known = verdicts.join(self.store.read_keys(verdicts).select("mint"), "mint", "left_semi")
        known = settled(known.select("mint", "phash", F.col("state").alias("phashState")), "verdicts")
        written = known.count()
        if written:
            self.index.around(known, lambda: self.store.tell_hashes(known))
        return written

    def retain(self, now: int) -> int:
        """Drops stale records; returns how many."""
        stale = settled(self.store.read().where(maintain.stale(self.thresholds, now)).select("mint"), "stale")
        removed = stale.count()
        if removed:
            self.index.around(stale, lambda: self.store.remove(stale))
        return removed
