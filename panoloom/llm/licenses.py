"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Word n-grams of each template are winnowed: of every ``WINDOW`` neighbouring hashes the smallest is kept. The kept ones form an
inverted index, hash to (template, position), whose size follows the templates alone and which travels with the function. Every n-gram of every
document is looked up, so a text that shares ``GRAM + WINDOW - 1`` words in a row with a template has a seed. Seeds of one template
on neighbouring diagonals are one candidate. The template is aligned with the words around it, inside a band around these diagonals; matched words
give coverage, the first and last of them the span. A match must hold the words that tell its license from others of the family (version,
NC, SA, Lesser) and none of theirs. A word of a text belongs to one notice: where templates share most of their words, only the one
with the most matched words stays, of equal ones that of the higher coverage.

A scan of the documents without a shuffle; nothing but matches leaves it.

Defined cases: words are runs of letters and digits, ASCII letters in either case; null and empty texts match nothing; repeated documents give
their rows each; a template of fewer than ``GRAM`` words is ignored; an empty table or no templates give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import words as wd
from .license_texts import BARRED, KEYS, TEMPLATES

GRAM, WINDOW = 3, 2
COVERAGE = 0.8
SHARED = 0.5            # share of a match's words from which on a better match takes its place
FOUND = "template int, license string, start long, end long, matched int, coverage double"


class Index(NamedTuple):
    names: list[str]
    templates: list[np.ndarray]     # word hashes
    hashes: np.ndarray              # sorted fingerprints, with template and position of each
    template: np.ndarray
    position: np.ndarray
    keys: list[np.ndarray]          # of each template, words a match must hold
    barred: list[np.ndarray]        # and words its span must not hold


def _hashes(text: str) -> np.ndarray:
    parts = [w.hash for w in wd.words(pa.array([text], pa.large_string()), wd.LETTERS, "ascii")]
    return parts[0] if parts else np.zeros(0, np.uint64)


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k:len(h) - n + 1 + k]
    return wd.scramble(out)


def winnowed(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every window, the rightmost of equal ones."""
    if len(g) <= window:
        return np.array([len(g) - 1 - int(g[::-1].argmin())], np.int64) if len(g) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


def index(templates=TEMPLATES) -> Index:
    names, texts, rows, keys, barred = [], [], [], [], []
    must, never = ({f: _hashes(" ".join(v)) for k, v in words.items() for f in k.split() or [""]} for words in (KEYS, BARRED))
    for name, text in templates:
        h = _hashes(text or "")
        if not len(h):
            continue
        g = grams(h, min(GRAM, len(h)))
        rows += [(int(g[p]), len(texts), int(p)) for p in winnowed(g)] if len(h) >= GRAM else []
        names.append(name)
        texts.append(h)
        family = name.split("-")[0]
        keys.append(np.intersect1d(np.concatenate([must[""], must.get(family, h[:0])]), h))
        barred.append(np.setdiff1d(never.get(family, h[:0]), h))
    rows.sort()
    cols = list(zip(*rows)) if rows else ([], [], [])
    return Index(names, texts, np.array(cols[0], np.uint64), np.array(cols[1], np.int64), np.array(cols[2], np.int64),
                 keys, barred)


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Matched positions of the best alignment of ``a`` and ``b``, cells with ``low <= j - i <= high`` only.

    Matches count 1, gaps and replacements 0; of equal alignments, the one that matches earliest in ``b`` from the end on.
    """
    width = high - low + 1
    best = np.zeros((len(a) + 1, width + 1), np.int32)      # best[i, k]: first i of a, b up to j = i + low + k - 1
    equal = np.zeros((len(a), width), bool)
    for i in range(len(a)):
        j = i + low + np.arange(width)
        ok = (j >= 0) & (j < len(b))
        equal[i] = ok & (b[np.clip(j, 0, len(b) - 1)] == a[i])
        up = np.append(best[i, 1:], best[i, -1])            # same j, one less of a
        step = up.copy()
        step[1:] = np.maximum(step[1:], best[i, 1:] + equal[i])
        best[i + 1] = np.maximum.accumulate(step)
    out, i, k = [], len(a), width
    while i > 0 and k >= 0:
        here = best[i, k]
        if k > 0 and best[i, k - 1] == here:
            k -= 1
        elif here == (best[i - 1, k + 1] if k + 1 <= width else best[i - 1, -1]):
            i, k = i - 1, min(k + 1, width)
        else:
            out.append((i - 1, i - 1 + low + k - 1))
            i -= 1
    return out[::-1]


def _candidates(ix: Index, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(template, lowest, highest start) of seeds of a template that begin within its band of each other."""
    g = grams(h)
    at = np.searchsorted(ix.hashes, g)
    hit = np.flatnonzero((at < len(ix.hashes)) & (ix.hashes[np.minimum(at, max(len(ix.hashes) - 1, 0))] == g)) if len(ix.hashes) else []
    seeds = []
    for p in hit:
        k = at[p]
        while k < len(ix.hashes) and ix.hashes[k] == g[p]:      # a gram of several templates
            seeds.append((int(ix.template[k]), int(p) - int(ix.position[k])))
            k += 1
    seeds.sort()
    held = None
    for t, start in seeds:
        if held and held[0] == t and start - held[2] <= band(len(ix.templates[t])) and start - held[1] < len(ix.templates[t]):
            held = (t, held[1], start)
        else:
            if held:
                yield held
            held = (t, start, start)
    if held:
        yield held


def band(size: int) -> int:
    return 4 + size // 8


def matches(ix: Index, h: np.ndarray, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, first word, end, matched) of all matches of a text; matches of one template do not overlap, others share few words."""
    found = []
    for t, first, last in _candidates(ix, h):
        a = ix.templates[t]
        wide = band(len(a))
        lo, hi = max(0, first - wide), min(len(h), last + len(a) + wide)
        region = h[lo:hi]
        if not np.isin(ix.keys[t], region).all() or np.isin(a, region).sum() < coverage * len(a):
            continue                                        # no alignment can do
        pairs = align(a, region, first - wide - lo, last + wide - lo)
        if len(pairs) < coverage * len(a):
            continue
        at = np.array([j for _, j in pairs])
        if np.isin(ix.keys[t], region[at]).all() and not np.isin(ix.barred[t], region[at[0]:at[-1] + 1]).any():
            found.append((t, lo + at))
    out: list[tuple[int, int, int, int]] = []
    taken = np.zeros(len(h), bool)
    for t, at in sorted(found, key=lambda m: (-len(m[1]), len(ix.templates[m[0]]), m[0], m[1][0])):
        s, e = int(at[0]), int(at[-1]) + 1
        if taken[at].mean() < SHARED and all(t != x[0] or e <= x[1] or s >= x[2] for x in out):
            taken[at] = True
            out.append((t, s, e, len(at)))
    return sorted(out, key=lambda m: (m[1], m[0]))


def scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``FOUND`` for every match; ``start`` and ``end`` are code points of the text."""
    ix = index(templates)
    rows = docs.select(F.col("doc_id").cast("long"), c.text_of(text_col).alias("__text"))
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for w in wd.words(batch.column("__text"), wd.LETTERS, "ascii"):
                if not len(w.hash) or not len(ix.hashes):
                    continue
                edge = w.per_doc()
                known = np.isin(grams(w.hash), ix.hashes)       # across borders too; checked per document below
                for d in np.unique(w.doc[np.flatnonzero(known)]):
                    for t, s, e, n in matches(ix, w.hash[edge[d]:edge[d + 1]], coverage):
                        begin, first, last = w.offsets[d], w.start[edge[d] + s], w.end[edge[d] + e - 1]
                        points = [len(w.data[begin:x].tobytes().decode("utf-8", "replace")) for x in (first, last)]
                        at.append(w.first + int(d))
                        out.append((t, ix.names[t], *points, n, n / len(ix.templates[t])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array([o[k] for o in out], kinds[k]) for k in range(6)],
                ["doc_id", *(f.split()[0] for f in FOUND.split(", "))])

    return rows.mapInArrow(run, f"doc_id long, {FOUND}")


def op10_licenses(spark, sf_dir):
    """License notices in all documents."""
    return scan(c.read(spark, sf_dir, "documents"))


QUERIES = {"op10_licenses": op10_licenses}
