"""Quality rules: bands of zstandard ratios, over whole texts and over fixed chunks, with limits by length.

A ratio is compressed bytes by bytes. Text that repeats itself is under its band, text that does not compress (keys, encoded
files, noise) over it. Short texts compress less, as a frame has a header and little to refer back to, so LIMITS go by length.
Whole texts are judged, and chunks of CHUNK bytes each by itself, the last by its own length (under LEAST_CHUNK bytes not): a
text goes, too, if more than BAD_SHARE of its bytes are in chunks out of their band, which averages over a text would hide.

Before that the base rules go by words, the runs of bytes that are not white space: fewer than LEAST_WORDS, or over half of
them in windows of WINDOW words that occur twice or more in the text.

Defined results: null text is empty, and empty text has no words and fails the base rules; equal texts are judged alike; each
row is judged alone, so row order and repeated rows change nothing; an empty table gives an empty table; columns other than
key and text are not read. Whole texts are read, however long; a text is held a slice at a time with others of SLICE_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from echofold.llm.batches import lean, slices, sums, utf8_view

LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 0.5
SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK, LEAST_CHUNK, BAD_SHARE = 4096, 256, 0.25
#: Bytes below which a row holds, and the least and the largest ratio there. Prose with letters of one to three bytes, of any
#: language, has 0.6 to 0.7 under a kilobyte and falls to 0.35 to 0.45 in long texts; lists and tables of repeated phrases have
#: 0.1 to 0.25, base64 0.76 and over.
LIMITS = [(256, 0.36, 1.10), (512, 0.33, 0.92), (1024, 0.30, 0.84), (2048, 0.28, 0.78), (8192, 0.25, 0.73), (65536, 0.22, 0.71), (np.inf, 0.15, 0.70)]
SLICE_BYTES = 1 << 20
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"


def in_band(size: np.ndarray, compressed: np.ndarray) -> np.ndarray:
    """Whether texts of so many bytes, compressed to so many, are within the limits of their length."""
    row = np.searchsorted([x[0] for x in LIMITS], size, "right")
    low, high = (np.array([x[k] for x in LIMITS])[row] for k in (1, 2))
    ratio = compressed / np.maximum(size, 1)
    return (ratio >= low) & (ratio <= high)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    code = pd.factorize(np.array(words, object))[0].astype(np.int64)
    window = code[:n]
    for k in range(1, WINDOW):
        window = np.unique(window * (int(code.max()) + 1) + code[k : k + n], return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def judged(text: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of its bytes in chunks out of their band, and whether it stays."""
    if not text:
        return 0.0, 0.0, False
    whole = len(squeeze.compress(text))
    chunks = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
    size = np.array([len(x) for x in chunks])
    judge = size >= LEAST_CHUNK
    bad = judge & ~in_band(size, np.array([len(squeeze.compress(x)) if ok else 0 for x, ok in zip(chunks, judge, strict=True)]))
    share = float(size[bad].sum() / len(text))
    return whole / len(text), share, bool(in_band(np.array([len(text)]), np.array([whole]))[0]) and share <= BAD_SHARE


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and OUT of each row. ratio and bad_share are what the bands were held against."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        white = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
        symbol = np.isin(np.arange(256), list(SYMBOLS))
        for part in slices(batches, "t", SLICE_BYTES):
            raw, offs = utf8_view(part.column(1))
            chars = sums((((raw & 0xC0) != 0x80) & ~white[raw]).astype(np.int64), offs)
            symbols = sums(symbol[raw].astype(np.int64), offs)
            texts = [raw[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            words = [x.split() for x in texts]
            n = np.array([len(x) for x in words], np.int64)
            again = np.array([repeated_words(x) for x in words], np.int64)
            lines = np.array([repeated_lines(x) for x in texts], np.int64)
            ratio, share, ok = (np.array(x) for x in zip(*[judged(x, squeeze) for x in texts], strict=True))
            failed = (n < LEAST_WORDS) | (again > MOST_REPEATED * n)
            columns = [n, chars, symbols, lines, again, failed, ok & ~failed, ratio, share]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in columns]], ["key", *[x.split()[0] for x in OUT.split(", ")]])

    found = rows.mapInArrow(lean(run), f"key {rows.schema['key'].dataType.simpleString()}, {OUT}")
    return found.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)

        def stays(value: bytes) -> bool:
            words = value.split()
            return len(words) >= LEAST_WORDS and repeated_words(words) <= MOST_REPEATED * len(words) and judged(value, squeeze)[2]

        for part in slices(batches, text, SLICE_BYTES):
            raw, offs = utf8_view(part.column(at))
            yield part.filter(pa.array([stays(raw[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
