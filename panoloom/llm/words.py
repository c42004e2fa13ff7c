"""Word positions and hashes of Arrow text columns, computed for many documents at once.

Texts are taken a bounded number of bytes at a time (a longer single text stands alone), so memory follows the longest
text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WORD_BYTES = 1 << 18      # words are taken from less text at a time, since each byte needs some 60 bytes meanwhile
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Bytes that belong to words: everything above the space, or only letters, digits and bytes of longer characters.
VISIBLE = np.arange(256) > 0x20
ASCII_LOWER = np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint8)
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


class Words(NamedTuple):
    """Words of the documents ``first .. first + len(offsets) - 1`` of a batch."""
    first: int                # row of the batch at which the slice begins
    data: np.ndarray          # bytes of the slice
    offsets: np.ndarray       # document borders in ``data``, one more than documents
    doc: np.ndarray           # document of each word, from 0
    start: np.ndarray         # byte range of each word
    end: np.ndarray
    hash: np.ndarray          # uint64
    sums: np.ndarray          # prefix hash of ``data``

    def per_doc(self) -> np.ndarray:
        """Index of each document's first word; one more entry than documents."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, (WORD_BYTES if n <= WORD_BYTES + 4096 else SLICE_BYTES) + 4096)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    if n <= SLICE_BYTES + 4096 < len(_POWERS[0]):      # do not keep the powers of one very long text
        out = _POWERS[0][:n], _POWERS[1][:n]
        _POWERS[:] = [p[:SLICE_BYTES + 4096].copy() for p in _POWERS]
        return out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``s`` with the hash of ``data[i:j]`` being ``(s[j] - s[i]) * INVERSE ** i``."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data))[0], out=s[1:])
    return s


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, borders) of consecutive documents."""
    arr = plain(column)
    n = len(arr)
    if not n:
        return
    bounds = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
        i = j


def words(column, table: np.ndarray = VISIBLE, lower: bool | str = True) -> Iterator[Words]:
    """Words of a text column, slice by slice. ``lower`` may be ``"ascii"``, which keeps every byte's place."""
    column = plain(column)
    for first, data, offsets in slices(column, WORD_BYTES):
        if lower is True:
            low = pc.utf8_lower(column.slice(first, len(offsets) - 1))
            _, data, offsets = next(slices(low, max(1, low.nbytes)))
        elif lower == "ascii":
            data = ASCII_LOWER[data]
        inside = table[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] |= inside[heads]                 # a word never runs on into the next document
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        ends[tails] |= inside[tails]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        s, inverse = prefix_hash(data), powers(len(data))[1]
        h = scramble((s[end] - s[start]) * inverse[start]) if len(start) else np.zeros(0, np.uint64)
        doc = np.searchsorted(offsets, start, side="right") - 1
        yield Words(first, data, offsets, doc, start, end, h, s)


def beginnings(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the first ``n`` bytes of every longer word; hashes differ from those of whole words."""
    longer = np.flatnonzero(w.end - w.start > n)
    start = w.start[longer]
    h = (w.sums[start + n] - w.sums[start]) * powers(len(w.data))[1][start] if len(start) else np.zeros(0, np.uint64)
    return w.doc[longer], scramble(h ^ np.uint64(0x5851F42D4C957F2D + n))


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``n`` words; a document of fewer words gives one hash of all of them.

    Documents without words give none.
    """
    edge = w.per_doc()
    count = np.diff(edge)
    k = len(w.hash)
    mult = np.uint64(0xD6E8FEB86659FD93)
    if k >= n:
        rolled = np.zeros(k - n + 1, np.uint64)
        for j in range(n):
            rolled = rolled * mult + w.hash[j:k - n + 1 + j]
        whole = w.doc[:k - n + 1] == w.doc[n - 1:]
        doc, h = w.doc[:k - n + 1][whole], scramble(rolled[whole])
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        tail = np.array([int(np.bitwise_xor.reduce(scramble(w.hash[edge[d]:edge[d + 1]] + np.arange(count[d], dtype=np.uint64))))
                         for d in short], np.uint64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, scramble(tail)])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h
