"""Arrow columns of texts in pieces of bounded bytes, so that a task's Python holds the objects of one piece at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive pieces of at most limit bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to - at
        at = to


def mapped(column: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """one() of each text, null for null; equal texts of a piece are told once."""
    out = []
    for at, n in pieces(column):
        piece = column.slice(at, n).dictionary_encode()
        told = pa.array([one(x) for x in piece.dictionary.to_pylist()], column.type)
        out.append(told.take(piece.indices))
    return pa.concat_arrays(out) if out else pa.array([], column.type)
