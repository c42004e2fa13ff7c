"""Frame features straight from stored planes, without unfolding a pixel table.

The same features as ``raster.feature_translucent`` and ``raster.feature_opaque``, for the bulk of the
data: every frame passes here, while only committed strips reach the panorama. Frames stay one row
each, the map needs no shuffle, and Arrow hands whole batches to the array arithmetic below. Out
comes packed ink (``ink.pack``), a few kilobytes per frame, which is all that matching and folding move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panoloom.operators.ink import words
from panoloom.operators.raster import gaussian_weights, line_length
from panoloom.settings import (ADAPTIVE_BLOCK, ADAPTIVE_C, BLACKHAT_SIZE, POLARITY_OPAQUE, POLARITY_TRANSLUCENT)

PIXELS_AT_ONCE = 1 << 22        # bounds the memory of one step, whatever the batch size
OUT = "video_id BIGINT, frame_idx BIGINT, width INT, height INT, cols ARRAY<BIGINT>"


def _slide(v: np.ndarray, axis: int, k: int, fn, outside: int) -> np.ndarray:
    r, n = k // 2, v.shape[axis]
    pad = [(0, 0)] * v.ndim
    pad[axis] = (r, r)
    wide, out = np.pad(v, pad, constant_values=outside), None
    for i in range(k):
        part = wide.take(range(i, i + n), axis) if axis == 1 else wide[:, :, i:i + n]
        out = part if out is None else fn(out, part)
    return out


def _blackhat(v: np.ndarray, k: int) -> np.ndarray:
    high = _slide(_slide(v, 2, k, np.maximum, -1), 1, k, np.maximum, -1)
    return _slide(_slide(high, 1, k, np.minimum, 256), 2, k, np.minimum, 256) - v


def _otsu(v: np.ndarray) -> np.ndarray:
    n, size = len(v), v[0].size
    shift = np.arange(n).reshape(-1, 1) * 256
    hist = np.bincount((v.reshape(n, -1) + shift).ravel(), minlength=n * 256).reshape(n, 256)
    n1 = np.cumsum(hist, axis=1)
    s1 = np.cumsum(hist * np.arange(256), axis=1)
    diff = (n1 * s1[:, -1:] - size * s1).astype(float)
    weight = n1.astype(float) * (size - n1).astype(float)
    spread = np.divide(diff * diff, weight, out=np.zeros_like(diff), where=weight > 0)
    level = np.where(spread.max(axis=1) > 0, spread.argmax(axis=1), 0)
    return v > level.reshape(-1, 1, 1)


def _adaptive(v: np.ndarray, block: int, c: int) -> np.ndarray:
    taps, r = gaussian_weights(block), block // 2
    area, s = sum(taps) ** 2, v.astype(np.int64)
    for axis in (2, 1):
        n, pad = s.shape[axis], [(0, 0)] * 3
        pad[axis] = (r, r)
        wide = np.pad(s, pad, mode="edge")
        s = sum(t * (wide[:, i:i + n] if axis == 1 else wide[:, :, i:i + n]) for i, t in enumerate(taps))
    return v <= (2 * s + area) // (2 * area) - c


def _without_lines(on: np.ndarray, kw: int) -> np.ndarray:
    if on.shape[2] < kw:
        return on
    run = np.cumsum(np.pad(on, ((0, 0), (0, 0), (1, 0))), axis=2)
    full = (run[:, :, kw:] - run[:, :, :-kw]) == kw
    edge = np.zeros(on.shape[:2] + (on.shape[2] + 1,), dtype=np.int32)
    edge[:, :, :full.shape[2]] += full
    edge[:, :, kw:kw + full.shape[2]] -= full
    return on & (np.cumsum(edge, axis=2)[:, :, :-1] == 0)


def _packed(on: np.ndarray) -> np.ndarray:
    n, h, w = on.shape
    tall = np.zeros((n, w, words(h) * 64), dtype=bool)
    tall[:, :, :h] = on.transpose(0, 2, 1)
    return np.packbits(tall, axis=2, bitorder="little").view("<u8").astype(np.uint64).view(np.int64).reshape(n, -1)


def _feature(b, g, r, opaque: bool) -> np.ndarray:
    v = (299 * r + 587 * g + 114 * b + 500) // 1000
    level = POLARITY_OPAQUE if opaque else POLARITY_TRANSLUCENT
    dark = v.sum(axis=(1, 2)) < v[0].size * level
    v = np.where(dark.reshape(-1, 1, 1), 255 - v, v)
    on = _adaptive(v, ADAPTIVE_BLOCK, ADAPTIVE_C) if opaque else _otsu(_blackhat(v, BLACKHAT_SIZE))
    return _packed(_without_lines(on, line_length(v.shape[2])))


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one frame size and bounded pixel count."""
    size = np.stack([batch.column("width").to_numpy(), batch.column("height").to_numpy()], axis=1)
    if len(size) == 0:
        return
    starts = [0, *(np.flatnonzero((size[1:] != size[:-1]).any(axis=1)) + 1), len(size)]
    for a, b in zip(starts, starts[1:]):
        step = max(1, PIXELS_AT_ONCE // max(1, int(size[a].prod())))
        for i in range(a, b, step):
            yield batch.slice(i, min(step, b - i))


def _whole(part: pa.RecordBatch) -> pa.RecordBatch:
    """The frames whose planes all have the size they state; others would shift the pixels of their neighbours."""
    area = part.column("width").to_numpy().astype(np.int64) * part.column("height").to_numpy()
    fits = np.logical_and.reduce([part.column(c).value_lengths().fill_null(-1).to_numpy() == area for c in "bgr"])
    return part if fits.all() else part.filter(pa.array(fits & (area > 0)))


def features(frames: DataFrame, opaque: bool = False) -> DataFrame:
    """Packed ink of normalised frames (``frames.normalise``), ``(video_id, frame_idx, width, height, cols)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(_whole(batch)):
                shape = (len(part), part.column("height")[0].as_py(), part.column("width")[0].as_py())
                planes = [part.column(c).flatten().to_numpy().astype(np.int32).reshape(shape) for c in "bgr"]
                cols = _feature(*planes, opaque)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(cols) + 1) * cols.shape[1], pa.int32()), pa.array(cols.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("video_id", "frame_idx", "width", "height")] + [lists],
                    names=["video_id", "frame_idx", "width", "height", "cols"])

    return frames.select("video_id", "frame_idx", "width", "height", "b", "g", "r").mapInArrow(run, OUT)
