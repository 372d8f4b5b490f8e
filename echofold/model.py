"""Thresholds and schemas. Times are epoch milliseconds, unparseable readings are null and never zero."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

MATCH_NAME, MATCH_SYMBOL, MATCH_URI, MATCH_IMAGE = "name", "symbol", "metadata", "image"
TRACKED = ["name", "symbol", "imageUrl", "metadataUri", "marketCapUsd", "volumeUsd", "ageSeconds"]


@dataclass(frozen=True)
class Narrative:
    min_similarity: float
    min_length: int = 3


@dataclass(frozen=True)
class Thresholds:
    """The tunables that results depend on."""

    narrative: Narrative = field(default_factory=lambda: Narrative(0.90))
    with_image: Narrative = field(default_factory=lambda: Narrative(0.72))
    min_peak_usd: float = 100_000.0
    min_age_ms: int = 3 * DAY_MS
    retention_ms: int = 30 * DAY_MS
    trigram_min_length: int = 3
    max_candidates: int = 200
    sample_size: int = 32
    dct_size: int = 8
    max_hamming: int = 10
    min_variance: float = 100.0
    retry_ms: int = 6 * HOUR_MS
    max_image_bytes: int = 2_000_000
    popover_rows: int = 50
    min_rows: int = 20
    floor: float = 0.5


THRESHOLDS = Thresholds()

LAUNCH = "mint string, name string, symbol string, uri string, observedAt double"
RAW_ROW = "mintHref string, mintText string, name string, symbol string, imageUrl string, metadataUri string, marketCap string, volume string, age string"
OBSERVATION = "mint string, name string, symbol string, imageUrl string, metadataUri string, marketCapUsd double, volumeUsd double, ageSeconds double, seenAt long, source string"
COIN = "mint string, name string, symbol string, normName string, normSymbol string, trigrams array<string>, imageUrl string, phash string, phashState string, firstSeen long, lastSeen long, peakMcUsd double, peakVolUsd double, ran boolean, sawMigrated boolean, sightings long"
#: What a run of the store tells of a record.
COIN_TOLD = "mint string, name string, symbol string, imageUrl string, firstSeen long, lastSeen long, peakMcUsd double, peakVolUsd double, sawMigrated boolean, sightings long, deleted boolean, hashed boolean, phash string, phashState string"
META = "startedAt long, schemaVersion int, coinCount long"
SOURCES = ["new-pairs", "final-stretch", "migrated", "trending", "detail", "imported", "other"]
