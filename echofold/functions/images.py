"""Perceptual hashes: luma, variance gate, low-frequency DCT block, median bits; and their distances.

Many pictures (of stripes, of repeated lines) have coefficients that are zero or equal but for rounding, so bits told by sums of
floating-point numbers hang on the order of their terms. Here luma is in thousandths and the basis in parts of BASIS, and all
sums are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from echofold.functions.pieces import pieces
from echofold.functions.text import bound
from echofold.model import THRESHOLDS, Thresholds

#: Rec. 601 luma, in thousandths; what the basis is rounded to a part of.
LUMA, BASIS = (299, 587, 114), 1 << 18
#: Bytes of an Arrow batch's contents that are listed at once, and pictures of them that are hashed at once, as their planes are many times their bytes.
PIECE_BYTES, PIECE = 1 << 22, 256
RESULT = "hash string, failure string, variance double"


def dct_basis(n: int) -> np.ndarray:
    """Rows are the orthonormal DCT-II basis."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    rows = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    rows[0] /= np.sqrt(2)
    return rows


def luma(rgba: np.ndarray) -> np.ndarray:
    """Planes (n, size, size) of RGBA bytes (n, size * size * 4)."""
    n = len(rgba)
    pixels = rgba.reshape(n, -1, 4)[:, :, :3].astype(float)
    size = int(np.sqrt(pixels.shape[1]))
    return (pixels @ np.array(LUMA, float)).reshape(n, size, size) / 1000


def block_bits(block: np.ndarray) -> np.ndarray:
    """Hex hashes of whole coefficient blocks (n, 64): bits over the median of all but the first, the first compared too. Of
    equal coefficients the later one counts as larger."""
    rest = block[:, 1:]
    order = np.argsort(rest, axis=1, kind="stable")
    middle = (rest.shape[1] - 1) // 2
    over = np.zeros(block.shape, bool)
    np.put_along_axis(over, order[:, middle + 1 :] + 1, True, axis=1)
    lower, upper = (np.take_along_axis(rest, order[:, k, None], axis=1)[:, 0] for k in (middle, rest.shape[1] // 2))
    over[:, 0] = 2 * block[:, 0] > lower + upper
    return np.array([x.tobytes().hex() for x in np.packbits(over, axis=1)], object)


def hash_planes(planes: np.ndarray, thresholds: Thresholds = THRESHOLDS) -> pd.DataFrame:
    """hash, failure and variance (in millionths, a half up) of luma planes (n, size, size) in thousandths, all at once."""
    size = planes.shape[-1]
    whole = np.rint(planes * 1000)
    flat = whole.reshape(len(planes), -1).astype(np.int64)
    spread = size**2 * (flat**2).sum(axis=1) - flat.sum(axis=1) ** 2  # the variance in millionths, size^4 times
    C = np.rint(dct_basis(size)[: thresholds.dct_size] * BASIS)
    across = (whole @ C.T).astype(np.int64)  # exact: under 2^53
    low = (C.astype(np.int64) @ across).reshape(len(planes), -1)
    dull = spread < thresholds.min_variance * 10**6 * size**4
    variance = (spread + size**4 // 2) // size**4 / 1e6
    return pd.DataFrame({"hash": np.where(dull, None, block_bits(low)), "failure": np.where(dull, "degenerate", None), "variance": variance})


def hashed(contents: list[bytes | None], thresholds: Thresholds = THRESHOLDS) -> pa.StructArray:
    """hash, failure and variance of size x size RGBA bytes; null or a wrong size is unavailable."""
    want = thresholds.sample_size**2 * 4
    ok = np.flatnonzero([x is not None and len(x) == want for x in contents])
    hashes, failures, variances = np.full(len(contents), None, object), np.full(len(contents), "unavailable", object), np.zeros(len(contents))
    for own in (ok[k : k + PIECE] for k in range(0, len(ok), PIECE)):
        rgba = np.frombuffer(b"".join(contents[k] for k in own), np.uint8).reshape(len(own), want)
        found = hash_planes(luma(rgba), thresholds)
        hashes[own], failures[own], variances[own] = found["hash"], found["failure"], found["variance"]
    return pa.StructArray.from_arrays([pa.array(hashes, pa.string()), pa.array(failures, pa.string()), pa.array(variances)], ["hash", "failure", "variance"])


def hash_pixels(content: Column, thresholds: Thresholds = THRESHOLDS, sampled: Callable[[list], list] = list) -> Column:
    """struct(hash, failure, variance) of size x size RGBA bytes, or of contents of which sampled() makes such; null or a wrong size is unavailable, too large as well."""

    @F.arrow_udf(RESULT)
    def run(contents: pa.Array) -> pa.Array:
        told = [hashed(sampled(contents.slice(at, n).to_pylist()), thresholds) for at, n in pieces(contents, PIECE_BYTES)]
        return pa.concat_arrays(told or [hashed([], thresholds)])

    return run(content)


def hash_coefficients(block: Column) -> Column:
    """The hash of 64 coefficients in an array, by built-in functions alone."""

    def median(rest: Column) -> Column:
        middle = F.size(rest) / 2
        return F.when(F.size(rest) % 2 == 1, F.get(rest, F.floor(middle).cast("int"))).otherwise((F.get(rest, (middle - 1).cast("int")) + F.get(rest, middle.cast("int"))) / 2)

    def digits(bits: Column) -> Column:
        return F.lower(F.concat(*[F.lpad(F.conv(bits.substr(16 * k + 1, 16), 2, 16), 4, "0") for k in range(4)]))

    values = F.transform(block, lambda x: x.cast("double"))
    rest = F.array_sort(F.slice(values, 2, F.size(block) - 1))
    bits = bound(bound(rest, median), lambda m: F.array_join(F.transform(values, lambda x: F.when(x > m, "1").otherwise("0")), ""))
    return bound(bits, digits)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; null where they can't be compared."""
    hex16 = "^[0-9a-fA-F]{16}$"
    half = lambda x, k: F.conv(x.substr(8 * k + 1, 8), 16, 10).cast("long")
    bits = sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in range(2)), F.lit(0))
    return F.when(a.rlike(hex16) & b.rlike(hex16), bits.cast("int"))


def images_match(distance: Column, thresholds: Thresholds = THRESHOLDS) -> Column:
    return F.coalesce(distance <= thresholds.max_hamming, F.lit(False))


def population_variance(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = total / F.size(values)
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean)) / F.size(values)
