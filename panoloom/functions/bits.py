"""Array arithmetic on packed columns, used inside tasks."""

from __future__ import annotations

import numpy as np


def unpack_columns(cols, width: int, words: int) -> np.ndarray:
    """A packed frame as unsigned words, one row per column."""
    return np.asarray(cols, dtype=np.int64).view(np.uint64).reshape(width, words)


def ones(bits: np.ndarray) -> np.ndarray:
    """Set bits per column."""
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def scores(ref: np.ndarray, tpl: np.ndarray, height: int) -> np.ndarray:
    """Phi of the template columns at every position of ``ref``."""
    tw = len(tpl)
    n, nt = tw * height, int(ones(tpl).sum())
    places = len(ref) - tw + 1
    if nt * (n - nt) == 0:
        return np.ones(places)
    cum = np.concatenate([[0], np.cumsum(ones(ref))])
    np_ = cum[tw:] - cum[:-tw]
    n11 = sum(np.bitwise_count(ref[i:i + places] & tpl[i]).sum(axis=1, dtype=np.int64) for i in range(tw))
    vp = np_ * (n - np_)
    root = np.sqrt(float(nt * (n - nt)) * vp.astype(float))
    return np.divide((n * n11 - nt * np_).astype(float), root, out=np.zeros(places), where=vp != 0)
