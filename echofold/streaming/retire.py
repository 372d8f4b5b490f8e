"""Records as keyed state with timers: a key is retired some time after its last sighting, unless it has run.

A key's figures and texts are one value, as each call of the state is a trip from Python to the JVM, and trips take most of the
time; a timer of event time stands at the end of its retention and moves with each batch of sightings. A key that is seen again after that time begins anew, whether the watermark has already passed its timer or not, so
what is retired depends on the sightings alone. Keys that ran keep no timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from echofold.model import THRESHOLDS, Thresholds
from echofold.operators.merge import MIGRATED

RETIRED = "mint string, name string, symbol string, firstSeen long, lastSeen long, peakMcUsd double, sightings long"
LIFE = "firstSeen long, lastSeen long, peakMcUsd double, ran boolean, sightings long, timer long, name string, symbol string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retirement(StatefulProcessor):
    def __init__(self, thresholds: Thresholds):
        self.thresholds = thresholds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)

    @staticmethod
    def _retired(key: tuple, life: tuple) -> Row:
        first, last, peak, _, sightings, _, name, symbol = life
        return Row(mint=key[0], name=name, symbol=symbol, firstSeen=first, lastSeen=last, peakMcUsd=peak, sightings=sightings)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.life.get()  # None where there is none
        known = tuple(held) if held else None
        timer = known[5] if known else None
        for r in sorted(rows, key=lambda r: (r.seenAt, r.seq)):
            if known and not known[3] and r.seenAt > known[1] + self.thresholds.retention_ms:
                yield self._retired(key, known)
                known = None
            ran = r.source == MIGRATED or (r.marketCapUsd is not None and r.marketCapUsd >= self.thresholds.min_peak_usd)
            first, last, peak, before, n, _, name, symbol = known or (r.seenAt, r.seenAt, None, False, 0, None, None, None)
            peaks = [x for x in (peak, r.marketCapUsd) if x is not None]
            texts = (r.name if name is None else name, r.symbol if symbol is None else symbol)
            known = (min(first, r.seenAt), max(last, r.seenAt), max(peaks, default=None), before or ran, n + 1, None, *texts)
        due = None if known[3] else known[1] + self.thresholds.retention_ms
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.life.update((*known[:5], due, *known[6:]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.life.get()
        if held:
            yield self._retired(key, tuple(held))
            self.life.clear()

    def close(self) -> None:
        pass


def retired(stream: DataFrame, late: str = "0 seconds", thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    """RETIRED rows of a stream of sightings with seq, as they are retired. late: how much later than others sightings may come.
    The session's state store must be ROCKS, which holds timers."""
    rows = stream.select("mint", "name", "symbol", "marketCapUsd", "source", "seenAt", "seq", F.timestamp_millis("seenAt").alias("at")).withWatermark("at", late)
    return rows.groupBy("mint").transformWithState(Retirement(thresholds), RETIRED, "append", "eventTime")
