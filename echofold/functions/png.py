"""PNG pictures to and from pixels, in numpy.

A row's filter predicts each byte from its left, upper and upper left neighbours. All rows' filters are undone together along
diagonals of the picture, as all three neighbours of a pixel lie on earlier ones; and those of all pictures of one layout at once,
as most of a small picture's time is that of calls.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import suppress
from typing import NamedTuple

import numpy as np

#: Fixed values of the format: its first bytes, samples a pixel by color type, and the passes of interlaced pictures (first
#: column and row, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
GRAY, RGB, PALETTE, GRAY_ALPHA, RGBA = SAMPLES
NONE, SUB, UP, AVERAGE, PAETH = range(5)
MOST_PIXELS = 1 << 24
#: Pixels of pictures that are undone at once; a larger picture is undone alone.
PIECE = 1 << 18


class BadPicture(ValueError):
    """Bytes that are no picture, a broken one, or one of too many pixels."""


class Layout(NamedTuple):
    w: int
    h: int
    depth: int
    color: int
    interlaced: bool

    def passes(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """First column and row, steps, columns and rows of each pass, and a row's bytes."""
        w, h, bits = self.w, self.h, self.depth * SAMPLES[self.color]
        own = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in PASSES if x < w and y < h] if self.interlaced else [(0, 0, 1, 1, w, h)]
        return [(*x, (x[4] * bits + 7) // 8) for x in own]


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks by type, data chunks joined; their checks are compared."""
    if not data.startswith(SIGNATURE):
        raise BadPicture("no PNG")
    out: dict[bytes, bytes] = {}
    at = len(SIGNATURE)
    while b"IEND" not in out:
        head = data[at : at + 8]
        if len(head) < 8:
            raise BadPicture("cut off")
        size, kind = struct.unpack(">I4s", head)
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check):
            raise BadPicture("cut off or damaged")
        out[kind] = out.get(kind, b"") + body
        at += 12 + size
    return out


def filters(kinds: np.ndarray) -> list[np.ndarray]:
    """For SUB, UP, AVERAGE and PAETH, 1 where it is the row's filter, else 0."""
    return [(kinds == kind).astype(np.int16) for kind in (SUB, UP, AVERAGE, PAETH)]


def predicted(own: list[np.ndarray], left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What filters() of rows predict, by products, as choices by place take five times as long."""
    sub, above, average, paeth = own
    a, b = up - corner, left - corner
    c = abs(a + b)
    nearest = corner + a * (abs(b) <= c)
    a, b = abs(a), abs(b)
    nearest += (left - nearest) * ((a <= b) & (a <= c))
    return nearest * paeth + left * sub + up * above + ((left + up) >> 1) * average


def unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes (n, h, w) of the filtered rows of n pictures; kinds: (n, h); step: bytes a pixel."""
    if not kinds.any():
        return rows
    n, h, wide = rows.shape
    w = wide // step
    out = np.zeros((h + 1, w + 1, step * n), np.int16)
    out[1:, 1:] = np.ascontiguousarray(rows.reshape(n, -1).T).reshape(h, w, -1)
    flat, kind = out.reshape(-1, step * n), filters(np.tile(kinds.T, (1, step)))
    for d in range(h + w - 1):
        first, end = max(0, d - w + 1), min(h, d + 1)
        at, to = first * w + d + w + 2, (end - 1) * w + d + w + 3  # a row further down, a column less
        own = flat[at:to:w]
        own += predicted([x[first:end] for x in kind], flat[at - 1 : to - 1 : w], flat[at - w - 1 : to - w - 1 : w], flat[at - w - 2 : to - w - 2 : w])
        own &= 255
    return np.ascontiguousarray(out[1:, 1:].astype(np.uint8).reshape(-1, n).T).reshape(n, h, wide)


def opened(data: bytes) -> tuple[Layout, dict[bytes, bytes], bytes]:
    """Layout, palette and transparency as far as they are used, and filtered rows."""
    parts = chunks(data)
    if len(parts.get(b"IHDR", b"")) != 13:
        raise BadPicture("no header")
    w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if color not in SAMPLES or depth not in (1, 2, 4, 8, 16) or not w or not h or w * h > MOST_PIXELS:
        raise BadPicture("an impossible size or color type")
    layout = Layout(w, h, depth, color, bool(interlaced))
    sizes = [(ph * (wide + 1), wide + 1) for *_, ph, wide in layout.passes()]
    most = sum(size for size, _ in sizes)
    try:
        raw = zlib.decompressobj().decompress(parts.get(b"IDAT", b""), most)
    except zlib.error as e:
        raise BadPicture("damaged data") from e
    if len(raw) < most:
        raise BadPicture("too little data")
    at = 0
    for size, line in sizes:
        if max(raw[at : at + size : line]) > PAETH:
            raise BadPicture("an unknown filter")
        at += size
    return layout, {kind: parts[kind][:768] for kind in (b"PLTE", b"tRNS") if kind in parts}, raw


def samples_of(layout: Layout, raws: list[bytes]) -> np.ndarray:
    """Samples (n, h, w, samples of the color type) of the filtered rows of n pictures, 16-bit ones by their upper half."""
    w, h, depth, color, _ = layout
    n, bits = len(raws), depth * SAMPLES[color]
    raw = np.frombuffer(b"".join(raws), np.uint8).reshape(n, -1)
    samples, at = np.zeros((n, h, w, SAMPLES[color]), np.uint8), 0
    for x, y, dx, dy, pw, ph, wide in layout.passes():
        lines = raw[:, at : at + ph * (wide + 1)].reshape(n, ph, wide + 1)
        at += ph * (wide + 1)
        own = unfiltered(lines[..., 1:], lines[..., 0], max(1, bits // 8))
        if depth == 16:
            own = own[..., ::2]
        elif depth < 8:
            own = np.unpackbits(own, axis=2).reshape(n, ph, -1, depth) @ (1 << np.arange(depth)[::-1])
            own = own[..., : pw * SAMPLES[color]] * (1 if color == PALETTE else 255 // (2**depth - 1))
        samples[:, y::dy, x::dx] = own.reshape(n, ph, pw, -1)
    return samples


def decode(data: bytes) -> np.ndarray:
    """Pixels (h, w, 4) of RGBA bytes, of any color type, depth and interlacing; 16-bit samples by their upper half."""
    layout, parts, raw = opened(data)
    return colored(samples_of(layout, [raw])[0], layout.color, layout.depth, parts)


def stacks(files: Iterable[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """decode() of files, in stacks (n, h, w, 4) of pictures alike, each with its files' places; those that can't be read are in none."""
    held, pixels = defaultdict(list), 0

    def done() -> Iterator[tuple[list[int], np.ndarray]]:
        for layout, own in held.items():
            places, stack = [], []
            for (place, parts, _), samples in zip(own, samples_of(layout, [raw for *_, raw in own]), strict=True):
                with suppress(BadPicture):
                    stack.append(colored(samples, layout.color, layout.depth, parts))
                    places.append(place)
            if places:
                yield places, np.stack(stack)
        held.clear()

    for place, data in enumerate(files):
        with suppress(BadPicture):
            layout, parts, raw = opened(data)
            if pixels + layout.w * layout.h > PIECE:
                yield from done()
                pixels = 0
            held[layout].append((place, parts, raw))
            pixels += layout.w * layout.h
    yield from done()


def colored(samples: np.ndarray, color: int, depth: int, parts: dict[bytes, bytes]) -> np.ndarray:
    """Samples as RGBA, by palette and transparent color where there are such."""
    if color == RGBA:
        return samples
    out = np.full((*samples.shape[:2], 4), 255, np.uint8)
    clear = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
    if color == PALETTE:
        table = np.frombuffer(parts.get(b"PLTE", b""), np.uint8)
        table = table[: len(table) // 3 * 3].reshape(-1, 3)
        if samples.max(initial=0) >= len(table):
            raise BadPicture("a color outside the palette")
        alpha = np.full(len(table), 255, np.uint8)
        alpha[: len(clear)] = clear[: len(table)]
        out[..., :3], out[..., 3] = table[samples[..., 0]], alpha[samples[..., 0]]
        return out
    out[..., :3] = samples[..., :1] if color in (GRAY, GRAY_ALPHA) else samples[..., :3]
    if color == GRAY_ALPHA:
        out[..., 3] = samples[..., -1]
    elif len(clear) == 2 * samples.shape[2]:
        value = clear.view(">u2").astype(int)
        value = value >> 8 if depth == 16 else value * (255 // (2**depth - 1)) if depth < 8 else value
        out[..., 3] = np.where((samples == value).all(axis=2), 0, 255)
    return out


def parts_of(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """size times the sums of an axis's size equal parts; what lies across an edge counts by its share, so all are whole numbers."""
    x = np.moveaxis(x, axis, 0)
    if len(x) % size == 0:
        return np.moveaxis(size * sum(x[k :: len(x) // size].astype(np.int64) for k in range(len(x) // size)), 0, axis)
    edge, share = np.divmod(np.arange(size + 1) * len(x), size)
    ends = share.reshape(-1, *[1] * (x.ndim - 1)) * x[np.minimum(edge, len(x) - 1)].astype(np.int64)
    whole = np.add.reduceat(x, edge[:-1], axis=0, dtype=np.int64)
    whole[edge[1:] == edge[:-1]] = 0
    return np.moveaxis(size * whole + ends[1:] - ends[:-1], 0, axis)


def shrunk(pixels: np.ndarray, size: int) -> np.ndarray:
    """Pixels (..., size, size, 4): each the mean, by area and by opacity, of what it covers; by area alone where all is clear, so
    that a picture's clear pixels keep their colors at any size. A half is rounded up, by whole numbers."""
    h, w = pixels.shape[-3:-1]
    if (h, w) == (size, size):
        return pixels
    total = lambda x: parts_of(parts_of(x, size, -3), size, -2)
    mean = lambda x, of: (2 * x + of) // (2 * of)
    weighed = pixels.astype(np.uint16)
    weighed[..., :3] *= pixels[..., 3:]
    color, alpha = np.split(total(weighed), [3], axis=-1)
    color = mean(color, np.maximum(alpha, 1))
    if not alpha.all():
        color = np.where(alpha > 0, color, mean(total(pixels[..., :3]), h * w))
    return np.concatenate([color, mean(alpha, h * w)], axis=-1).astype(np.uint8)


def encode(samples: np.ndarray, color: int, kinds: np.ndarray, palette: bytes | None = None) -> bytes:
    """A PNG of bytes (h, w, samples of the color type), each row by its filter."""
    return encoded(samples[None], color, kinds[None], palette)[0]


def encoded(samples: np.ndarray, color: int, kinds: np.ndarray, palette: bytes | None = None) -> list[bytes]:
    """PNGs of bytes (n, h, w, samples of the color type); kinds: (n, h)."""
    n, h, w, step = samples.shape
    padded = np.zeros((n, h + 1, w + 1, step), np.int16)
    padded[:, 1:, 1:] = samples
    own = padded[:, 1:, 1:] - predicted(filters(kinds[..., None, None]), padded[:, 1:, :-1], padded[:, :-1, 1:], padded[:, :-1, :-1])
    lines = np.concatenate([kinds[..., None].astype(np.uint8), own.astype(np.uint8).reshape(n, h, -1)], axis=2)
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    head = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"")
    return [head + chunk(b"IDAT", zlib.compress(x.tobytes())) + chunk(b"IEND", b"") for x in lines]
