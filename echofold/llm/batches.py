"""Arrow batch plumbing shared by the operators: views of UTF-8 columns and byte-bounded slices."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_ROWS = 500


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len+1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds at most limit bytes, or one row."""
    for batch in batches:
        _, offs = utf8_view(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), np.arange(len(raw), dtype=np.int64)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), starts


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i]+count[i]-1 for each i, one after the other."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1])


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i+1]] along the first axis; 0 where that is empty."""
    out = np.zeros((len(offs) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offs[full], axis=0)
    return out


def release() -> None:
    """Gives memory that Arrow and malloc hold for reuse back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run for mapInArrow, with memory given back when a partition ends. Called on the driver, it also bounds the rows of
    the session's Arrow batches to BATCH_ROWS, as 10,000 long texts at once are many times what a kernel holds."""
    session = SparkSession.getActiveSession()
    if session is not None and int(session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run
