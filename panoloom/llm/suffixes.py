"""Two-stage suffix sorting of many short byte strings at once, to a bounded depth.

A suffix is of type B if it is smaller than its successor, else of type A. Only B suffixes are sorted directly; the A suffixes
follow from scans of the buckets of first symbols in ascending order: the predecessor of a suffix that is already in place is the
next of its own bucket.
"""

from __future__ import annotations

import numpy as np

from . import words as wd


def joined(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each string): bytes plus one, a 0 after every string and ``depth`` + 8 more at the end.

    UTF-8 has no byte 0xFF, so symbols stay bytes.
    """
    size = np.array([len(s) for s in strings], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    text = np.zeros(int(size.sum()) + len(strings) + depth + 8, np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(strings)), size)
    text[at] = flat + np.uint8(1)
    return text, start


def keys(text: np.ndarray, n: int) -> np.ndarray:
    """The 8 symbols from each of the first ``n`` positions on, as a number that sorts like them."""
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[k:n + k]
    return out


def smaller_than_next(text: np.ndarray, n: int) -> np.ndarray:
    """Type B of the first ``n`` positions; runs of one symbol take the type of their end."""
    t = text[:n + 1].astype(np.int16)
    rise = np.sign(t[1:] - t[:-1])
    rise[-1] = 1                                     # the last separator
    at = np.where(rise != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rise[at] > 0


class _Prefixes:
    """Lengths of common prefixes by hashes of ranges, for many pairs at once."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.sums, self.inverse = wd.prefix_hash(text), wd.powers(len(text))[1]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.depth, np.int64)
        ip, iq, sp, sq = self.inverse[p], self.inverse[q], self.sums[p], self.sums[q]
        for _ in range(int(self.depth).bit_length()):
            mid = (low + high + 1) // 2
            same = (self.sums[p + mid] - sp) * ip == (self.sums[q + mid] - sq) * iq
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def sort_directly(text: np.ndarray, positions: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes to ``depth`` symbols.

    After the first 8 symbols, each group of equals is split around its first member: by the length of the common prefix and the symbol
    after it. Suffixes equal to it to the full depth stay together.
    """
    order = positions[np.argsort(key[positions], kind="stable")]
    k = key[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    prefixes = None
    rank = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    alone = first & np.concatenate([first[1:], [True]]) if len(k) else first
    active = np.flatnonzero(~alone)
    while len(active):
        prefixes = prefixes or _Prefixes(text, depth)
        p, q = order[active], order[rank[active]]
        n = prefixes.common(p, q)
        a, b = text[p + n].astype(np.int64), text[q + n].astype(np.int64)
        side = np.where(n == depth, 0, np.sign(a - b))
        code = np.where(side < 0, n * 256 + a, np.where(side == 0, (depth + 1) * 256, (2 * depth + 2 - n) * 256 + a))
        mixed = rank[active] * (1 << 20) + code
        by = np.argsort(mixed, kind="stable")
        order[active], mixed, equal = p[by], mixed[by], (side == 0)[by]
        head = np.concatenate([[True], mixed[1:] != mixed[:-1]])
        rank[active] = active[np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))]
        single = head & np.concatenate([head[1:], [True]])
        active = active[~single & ~equal]
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in order to ``depth`` symbols, of text as ``joined`` makes it."""
    n = len(text) - depth - 8
    b = smaller_than_next(text, n)
    direct = sort_directly(text, np.flatnonzero(b), keys(text, n), depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for s in np.unique(text[:n]):
        level = np.concatenate(waiting[s]) if waiting[s] else np.zeros(0, np.int64)
        bucket = []
        while len(level):                             # a suffix in this bucket may place its predecessor in it as well
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == s]
        bucket.append(direct[ends[s]:ends[s + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > s]
        if len(before):
            symbol = text[before]
            by = np.argsort(symbol, kind="stable")
            cuts = np.flatnonzero(np.diff(symbol[by])) + 1
            for part in np.split(before[by], cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated(strings: list[bytes], starts: list[int], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Which of the first ``starts[k]`` positions of string ``k`` begin ``depth`` bytes that also begin at another such position.

    Returns a flag per position and, for all positions in order of strings, the number of its class of equal ones.
    """
    text, begin = joined(strings, depth)
    count = np.asarray(starts, np.int64)
    owner = np.repeat(np.arange(len(strings)), count)
    edge = np.concatenate([[0], np.cumsum(count)])
    place = begin[owner] + np.arange(edge[-1]) - edge[owner]
    slot = np.full(len(text), -1)
    slot[place] = np.arange(len(place))
    array = suffix_array(text, depth)
    array = array[slot[array] >= 0]
    key = keys(text, len(text) - 8)
    same = np.ones(max(len(array) - 1, 0), bool)      # adjacent common prefixes of depth or more, byte by byte
    p, q = array[:-1], array[1:]
    live = np.arange(len(same))
    for k in range(0, depth - 7, 8):
        equal = key[p[live] + k] == key[q[live] + k]
        same[live[~equal]] = False
        live = live[equal]
    if depth % 8 and len(live):
        equal = key[p[live] + depth - 8] == key[q[live] + depth - 8]
        same[live[~equal]] = False
    group = np.concatenate([[0], np.cumsum(~same)]) if len(array) else np.zeros(0, np.int64)
    twice = np.bincount(group, minlength=1)[group] > 1 if len(array) else np.zeros(0, bool)
    flags, classes = np.zeros(len(place), bool), np.zeros(len(place), np.int64)
    flags[slot[array]], classes[slot[array]] = twice, group
    return [flags[edge[k]:edge[k + 1]] for k in range(len(strings))], classes
