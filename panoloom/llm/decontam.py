"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words in steps of ``BLOCK`` words, over whole texts. Their TF-IDF vectors, on the words
that the benchmark uses, are projected on singular vectors of a randomised SVD: directions that the items' passages span, turned and scaled
by the covariance of every window of every document there, which is one distributed sum. Windows whose
cosine with a passage of an item is high enough are candidates, if their plain TF-IDF cosine is not low; the longest common subsequence of the item and the words
around the window then decides, together with a check that the item's answer is there where the match is loose and an answer is given.
Items longer than a window leak by a passage too: a window of theirs that is there almost word by word, or two of them loosely.

Items of at most ``SHORT`` words would be diluted in a window by the words around them. They are searched by their rarest words as well,
exactly: a match misses few of an item's words, so some ``AGREE`` of that many more of its rarest are there, close together.

Document frequencies, the SVD and the search see every window of every document, nothing comes from a sample. In the SVD the corpus and the items' own
passages have half of the weight each. There is no shuffle of documents or windows.

The benchmark is the query set. It is taken ``ITEMS`` items at a time: per block of items, vocabulary, basis and passages are
bounded by that number and travel with the function. Documents never meet each other.

Defined cases: words are lower-cased runs of letters and digits; null or empty texts and items without words match nothing; an item
shorter than a window is one passage; repeated documents give equal rows each; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import words as wd

BLOCK, SPAN = 8, 3
WINDOW = BLOCK * SPAN
SLOTS = 1 << 16         # document frequencies are kept per slot of the word hash
RANK, EXTRA, ROUNDS = 128, 16, 2
ITEMS = 2_000           # items per search
COSINE, PLAIN = 0.6, 0.4
STRICT, LOOSE = 0.8, 0.6
ANSWER = 0.8            # share of the answer's words that a loose match must hold
SHORT, AGREE = 31, 3    # items searched by words as well, and how many of their rarest words must be near each other
LONG = 10               # words in order from which on a loose match needs no stand-in for an answer that is not given
FOUND = "item_id long, lcs int, coverage double, cosine double, start_word long, end_word long, answer boolean"


class Item(NamedTuple):
    item_id: int
    words: np.ndarray       # uint64
    answer: np.ndarray
    given: bool


def slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per slot over all documents, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for w in wd.words(batch.column("__text"), wd.LETTERS):
                df += np.bincount(np.unique(w.doc * SLOTS + slot(w.hash)) % SLOTS, minlength=SLOTS)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["slot", "n"])

    rows = docs.select(c.text_of(text_col).alias("__text")).mapInArrow(run, "slot long, n long")
    out, n = np.zeros(SLOTS), 0
    for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():      # at most one row per slot
        if r["slot"] < 0:
            n = r["n"]
        else:
            out[r["slot"]] = r["n"]
    return out, n


def _answer(text: str, given: str | None) -> str:
    """The answer of an item: the one given, else its last sentence."""
    if given:
        return given
    parts = [p for p in text.replace("\n", " ").split(". ") if p.strip(" .")]
    return parts[-1] if parts else ""


def read_items(rows: list[tuple[int, str | None, str | None]]) -> list[Item]:
    """Items with words from (item_id, text, answer or None)."""
    rows = [(i, t or "", a) for i, t, a in rows if i is not None]

    def hashes(texts):
        out = []
        for w in wd.words(pa.array(texts, pa.large_string()), wd.LETTERS):
            edge = w.per_doc()
            out += [w.hash[edge[k]:edge[k + 1]] for k in range(len(w.offsets) - 1)]
        return out
    found = zip(rows, hashes([t for _, t, _ in rows]), hashes([_answer(t, a) for _, t, a in rows]))
    return [Item(i, h, a, bool(given)) for (i, _, given), h, a in found if len(h)]


class Lookup(NamedTuple):
    """Places of words in a sorted vocabulary, by the low bits of their hash; only where these clash by a search."""
    vocabulary: np.ndarray
    table: np.ndarray       # place, the size of the vocabulary for none, or less than 0 where words share the bits

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each word, the size of the vocabulary for others."""
        at = self.table[(h & np.uint64(len(self.table) - 1)).astype(np.int64)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.minimum(np.searchsorted(self.vocabulary, h[shared]), len(self.vocabulary) - 1)
        some = np.flatnonzero(at < len(self.vocabulary))
        at[some[self.vocabulary[at[some]] != h[some]]] = len(self.vocabulary)
        return at


def lookup(vocabulary: np.ndarray) -> Lookup:
    size = 1 << max(16, int(32 * len(vocabulary)).bit_length())
    bits = (vocabulary & np.uint64(size - 1)).astype(np.int64)
    table = np.full(size, len(vocabulary), np.int32)
    table[bits] = np.arange(len(vocabulary))
    same, n = np.unique(bits, return_counts=True)
    table[same[n > 1]] = -1
    return Lookup(vocabulary, table)


class Index(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    known: Lookup
    basis: np.ndarray       # words x rank
    idf: np.ndarray         # per slot
    items: list[Item]
    passages: np.ndarray    # unit rows in the latent space
    owner: np.ndarray       # item of each passage, and its first word
    offset: np.ndarray
    keys: np.ndarray        # sorted passage * (words + 1) + word, and the weight of the word in the unit passage
    entries: np.ndarray
    short: list[int]        # short items
    rare: np.ndarray        # sorted words of which some must be in a match, and the place in ``short`` of the item of each
    rare_of: np.ndarray


class Blocks(NamedTuple):
    """Blocks of ``BLOCK`` words of one slice."""
    doc: np.ndarray         # document
    place: np.ndarray       # first word in it
    terms: np.ndarray       # blocks x BLOCK positions in the vocabulary; its size for other words and for no word
    mass: np.ndarray        # squared TF-IDF weights of all its words
    known: np.ndarray       # and of those of the vocabulary


def blocks_of(w: wd.Words, known: Lookup, idf: np.ndarray) -> Blocks:
    edge = w.per_doc()
    count = np.diff(edge)
    blocks = -(-count // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    n = int(base[-1])
    place = np.arange(len(w.hash)) - edge[w.doc]
    at = base[w.doc] * BLOCK + place
    term = known.places(w.hash)
    terms = np.full(n * BLOCK, len(known.vocabulary))
    terms[at] = term
    hit = term < len(known.vocabulary)
    mass = idf[slot(w.hash)] ** 2
    doc = np.repeat(np.arange(len(count)), blocks)
    return Blocks(doc, (np.arange(n) - base[doc]) * BLOCK, terms.reshape(n, BLOCK), np.bincount(at // BLOCK, mass, minlength=n),
                  np.bincount(at[hit] // BLOCK, mass[hit], minlength=n))


def weighted(basis: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of the basis times the weight of their word, and a row of zeros for all other words."""
    rows = basis * idf[slot(vocabulary)][:, None].astype(basis.dtype)
    return np.concatenate([rows, np.zeros((1, basis.shape[1]), basis.dtype)])


def projected(terms: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = rows[terms[:, 0]]
    for k in range(1, terms.shape[1]):
        out += rows[terms[:, k]]
    return out


def windows(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over ``SPAN`` blocks from each block on, never beyond its document."""
    out = values.copy()
    for k in range(1, SPAN):
        if len(doc) > k:
            same = (doc[k:] == doc[:-k]).astype(values.dtype)
            out[:-k] += values[k:] * (same[:, None] if values.ndim > 1 else same)
    return out


def _covariance(column, known: Lookup, idf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of outer products of the unit TF-IDF windows of some texts, projected on ``rows``; number of windows."""
    out, n = np.zeros((rows.shape[1], rows.shape[1])), 0
    low = pc.utf8_lower(wd.plain(column))
    for first, _, offsets in wd.slices(low):                # one product for so much text, whose words come in smaller slices
        parts = []
        for w in wd.words(low.slice(first, len(offsets) - 1), wd.LETTERS, lower=False):
            if not len(w.hash):
                continue
            b = blocks_of(w, known, idf)
            n += len(b.doc)
            y = windows(b.doc, projected(b.terms, rows))
            y /= np.sqrt(np.maximum(windows(b.doc, b.mass), 1e-9)).astype(y.dtype)[:, None]
            parts.append(y)
        if parts:
            y = np.concatenate(parts)
            out += y.T @ y
    return out, n


def fit(docs: DataFrame, items: list[Item], idf: np.ndarray, rank: int = RANK, text_col: str = "text") -> Index:
    """Randomised subspace iteration on the passages, then one distributed sum: the covariance of all windows of ``docs`` in that subspace.

    Directions are scaled to equal variance, so that no language's everyday words decide a cosine. There are at most half as many as
    passages: beyond those, scaling would raise directions that no passage needs.
    """
    vocabulary = np.unique(np.concatenate([i.words for i in items]))
    rng = np.random.default_rng(9)
    own = [(k, s) for k, item in enumerate(items) for s in range(0, max(1, len(item.words) - WINDOW + BLOCK), BLOCK)]
    rank = min(rank, max(1, len(own) // 2))
    q, _ = np.linalg.qr(rng.standard_normal((len(vocabulary), min(len(vocabulary), rank + EXTRA))))
    rows = [items[k].words[s:s + WINDOW] for k, s in own]
    place = np.concatenate([np.searchsorted(vocabulary, r) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = idf[slot(vocabulary[place])]
    unit = weight / np.maximum(np.sqrt(np.bincount(row, weight ** 2)), 1e-9)[row]

    def project(m):
        y = np.zeros((len(rows), m.shape[1]))
        np.add.at(y, row, m[place] * unit[:, None])
        return y

    def back(y):
        m = np.zeros((len(vocabulary), y.shape[1]))
        np.add.at(m, place, y[row] * unit[:, None])
        return m

    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(back(project(q)))
    known = lookup(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((q.shape[1], q.shape[1])), 0
        scaled = weighted(q.astype(np.float32), vocabulary, idf)
        for batch in batches:
            part, k = _covariance(batch.column("__text"), known, idf, scaled)
            total, n = total + part, n + k
        starts = np.arange(0, len(total), 16)
        parts = [total[s:s + 16].tobytes() for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *starts.tolist()], pa.int64()),
                                          pa.array([np.array([float(n)]).tobytes(), *parts], pa.binary())], ["first", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in pdf["part"])
        return pd.DataFrame({"first": pdf["first"][:1], "part": [total.tobytes()]})

    shape, corpus, n = "first long, part binary", np.zeros((q.shape[1], q.shape[1])), 1.0
    texts = docs.select(c.text_of(text_col).alias("__text"))
    for r in texts.mapInArrow(run, shape).groupBy("first").applyInPandas(add, shape).toLocalIterator():
        got = np.frombuffer(r["part"])
        if r["first"] < 0:
            n = max(1.0, got[0])
        else:
            got = got.reshape(-1, q.shape[1])
            corpus[r["first"]:r["first"] + len(got)] = got
    own_part = project(q)
    value, vector = np.linalg.eigh(corpus / n + own_part.T @ own_part / len(rows))
    top = np.argsort(-value)[:rank]
    spread = np.sqrt(np.maximum(value[top], 1e-6 * max(value.max(), 1e-30)))
    basis = ((q @ vector[:, top]) / spread).astype(np.float32)
    z = project(basis)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    keys = row * (len(vocabulary) + 1) + place
    order = np.unique(keys)
    entries = np.zeros(len(order))
    np.add.at(entries, np.searchsorted(order, keys), unit)
    return Index(vocabulary, known, basis, idf, items, z.astype(np.float32), np.array([k for k, _ in own]), np.array([s for _, s in own]),
                 order, entries, *_rarest(items, idf))


def _rarest(items: list[Item], idf: np.ndarray, loose: float = LOOSE) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Short items, and sorted pairs of word and item: of ``n`` words, ``need`` of which match, the rarest ``n - need + AGREE``."""
    short = [k for k, i in enumerate(items) if len(i.words) <= SHORT]
    pairs = []
    for place, k in enumerate(short):
        words = items[k].words
        need = int(np.ceil(loose * len(words) - 1e-9))
        first = np.lexsort((words, -idf[slot(words)]))[:len(words) - need + min(AGREE, need)]
        pairs += [(int(x), place) for x in np.unique(words[first])]
    pairs.sort()
    return short, np.array([x for x, _ in pairs], np.uint64), np.array([p for _, p in pairs], np.int64)


def lcs(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Lengths of longest common subsequences of pairs, all pairs at once."""
    wide, high = max(map(len, items)), max(map(len, regions))
    a, b = np.zeros((len(items), wide), np.uint64), np.full((len(items), high), 1, np.uint64)      # unequal padding
    for k, (x, y) in enumerate(zip(items, regions)):
        a[k, :len(x)], b[k, :len(y)] = x, y
    best = np.zeros((len(items), wide + 1), np.int16 if wide < 32_000 else np.int32)
    for j in range(high):
        step = best.copy()
        np.maximum(step[:, 1:], best[:, :-1] + (a == b[:, j:j + 1]), out=step[:, 1:])
        best = np.maximum.accumulate(step, axis=1)
    return best[:, -1]


def plain_cosine(b: Blocks, mass: np.ndarray, ix: Index, win: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Cosines of windows and passages on their TF-IDF vectors."""
    out = np.zeros(len(win))
    idf = np.append(ix.idf[slot(ix.vocabulary)], 0.0)
    for k in range(SPAN):
        at = np.minimum(win + k, len(b.doc) - 1)
        inside = (win + k < len(b.doc)) & (b.doc[at] == b.doc[win])
        for j in range(BLOCK):
            term = b.terms[at, j]
            key = passage * (len(ix.vocabulary) + 1) + term
            i = np.minimum(np.searchsorted(ix.keys, key), len(ix.keys) - 1)
            out += np.where(inside & (ix.keys[i] == key), ix.entries[i] * idf[term], 0.0)
    return out / np.sqrt(np.maximum(mass[win], 1e-9))


def _parts(w: wd.Words, b: Blocks, ix: Index, win: np.ndarray, passage: np.ndarray, score: np.ndarray, strict: float, loose: float):
    """Matches of passages of long items; ``coverage`` stays the share of the whole item."""
    edge = w.per_doc()
    for span, least in ((WINDOW, strict), (2 * WINDOW, loose)):
        slack = BLOCK + span // 4
        for s in range(0, len(win), 1024):
            doc, first, own = b.doc[win[s:s + 1024]], b.place[win[s:s + 1024]], passage[s:s + 1024]
            its = [ix.items[k] for k in ix.owner[own]]
            spans = [i.words[o:o + span] for i, o in zip(its, ix.offset[own])]
            regions = [w.hash[edge[d] + max(0, p - slack):min(edge[d + 1], edge[d] + p + span + slack)] for d, p in zip(doc, first)]
            for k, n in enumerate(lcs(spans, regions)):
                item, region = its[k], regions[k]
                if n < least * span:
                    continue
                answer = bool(len(item.answer)) and float(np.isin(item.answer, region).mean()) >= ANSWER
                if least < strict and item.given and not answer:
                    continue
                at = max(0, int(first[k]) - slack)
                begin, end = _ends(spans[k], region, int(n))
                yield (int(doc[k]), item.item_id, int(n), float(n / len(item.words)), float(score[s + k]), at + begin, at + end, answer)


def _ends(item: np.ndarray, region: np.ndarray, n: int) -> tuple[int, int]:
    """First word and end of a common subsequence of ``n`` words, the longest there is: the earliest end, then the latest beginning."""

    def reached(a: list[int], b: list[int]) -> int:
        """Words of ``b`` until ``n`` words are in order, by one integer of a bit for each word of ``a``."""
        places: dict[int, int] = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        whole = free = (1 << len(a)) - 1
        for j, x in enumerate(b):
            if x in places:
                hit = free & places[x]
                free = (free + hit | free - hit) & whole
                if len(a) - free.bit_count() >= n:
                    return j + 1
        return len(b)

    own, there = item.tolist(), region.tolist()
    end = reached(own, there)
    return end - reached(own[::-1], there[:end][::-1]), end


def _accepted(item: Item, region: np.ndarray, n: int, strict: float, loose: float) -> tuple[bool, bool]:
    """Whether ``n`` words in order are a match of the whole item, and whether the answer is there."""
    share = n / len(item.words)
    if share < loose:
        return False, False
    answer = bool(len(item.answer)) and float(np.isin(item.answer, region).mean()) >= ANSWER
    return share >= strict or answer or not item.given and n >= LONG, answer


def _plain(item: np.ndarray, region: np.ndarray, idf: np.ndarray) -> float:
    """Cosine of two short texts on their TF-IDF vectors, on the item's words."""
    words, m = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, region), len(words) - 1)
    n = np.bincount(at[words[at] == region], minlength=len(words))
    square = idf[slot(words)] ** 2
    return float((m * n * square).sum() / max(1e-9, np.sqrt((m * m * square).sum() * (n * n * square).sum())))


def _search_short(w: wd.Words, ix: Index, strict: float, loose: float):
    """Matches of short items whose rarest words are near each other, whatever stands around them."""
    if not len(ix.rare):
        return
    some = np.zeros(SLOTS, bool)
    some[slot(ix.rare)] = True
    at = np.flatnonzero(some[slot(w.hash)])                 # few words share the slot of a rare one
    first, last = (np.searchsorted(ix.rare, w.hash[at], side) for side in ("left", "right"))
    at, first, count = at[last > first], first[last > first], (last - first)[last > first]
    pos = np.repeat(at, count)
    own = ix.rare_of[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    order = np.lexsort((pos, own))
    pos, own = pos[order], own[order]
    n = np.array([len(ix.items[k].words) for k in ix.short])
    agree = np.minimum(AGREE, np.ceil(loose * n - 1e-9).astype(np.int64))
    slack = 1 + n // 4
    reach = n + slack                                       # a match lies inside so many words
    edge = w.per_doc()
    end = np.arange(len(pos)) + agree[own] - 1
    ok = end < len(pos)
    start, end = np.flatnonzero(ok), end[ok]
    ok = (own[end] == own[start]) & (w.doc[pos[end]] == w.doc[pos[start]]) & (pos[end] - pos[start] < reach[own[start]])
    start, end = start[ok], end[ok]
    who, doc, step = own[start], w.doc[pos[start]], slack[own[start]]
    low, high = (pos[end] - edge[doc] - reach[who] + 1) // step, (pos[start] - edge[doc]) // step       # steps a match may begin in
    size = high - low + 1
    which = np.repeat(np.arange(len(start)), size)
    begin = np.maximum(0, low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size))
    tried = np.unique(np.stack([who[which], doc[which], begin * step[which]], 1), axis=0) if len(which) else np.zeros((0, 3), np.int64)
    tried = tried[np.argsort(n[tried[:, 0]], kind="stable")]
    for s in range(0, len(tried), 1024):
        part = tried[s:s + 1024]
        its = [ix.items[ix.short[k]] for k in part[:, 0]]
        regions = [w.hash[edge[d] + b:min(edge[d + 1], edge[d] + b + reach[k] + slack[k])] for k, d, b in part]
        for (_, d, b), item, region, got in zip(part, its, regions, lcs([i.words for i in its], regions)):
            fine, answer = _accepted(item, region, got, strict, loose)
            if fine:
                begin, end = _ends(item.words, region, int(got))
                yield (int(d), item.item_id, int(got), float(got / len(item.words)), _plain(item.words, region, ix.idf), int(b) + begin, int(b) + end, answer)


def _search_slice(w: wd.Words, ix: Index, scaled: np.ndarray, cosine: float, plain: float, strict: float, loose: float):
    """Matches of one slice: (document, item, lcs, coverage, cosine, first word, end, answer)."""
    yield from _search_short(w, ix, strict, loose)
    b = blocks_of(w, ix.known, ix.idf)
    doc, place, mass = b.doc, b.place, windows(b.doc, b.mass)
    likely = np.flatnonzero(windows(doc, b.known) >= plain ** 2 * mass)       # others cannot reach the plain cosine
    z = windows(doc, projected(b.terms, scaled))[likely]
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    hits = []
    for first in range(0, len(ix.passages), 512):
        score = z @ ix.passages[first:first + 512].T
        hot = np.flatnonzero(score.ravel() >= cosine)
        win, passage = np.divmod(hot, score.shape[1])
        hits.append((likely[win], passage + first, score.ravel()[hot]))
    win, passage, score = (np.concatenate(x) for x in zip(*hits))
    full = plain_cosine(b, mass, ix, win, passage)
    win, passage, score = win[full >= plain], passage[full >= plain], score[full >= plain]
    if not len(win):
        return
    edge = w.per_doc()
    size = np.array([len(i.words) for i in ix.items])[ix.owner[passage]]
    slack = BLOCK + size // 4
    lo = np.maximum(0, place[win] - ix.offset[passage] - slack)
    hi = np.minimum(np.diff(edge)[doc[win]], place[win] - ix.offset[passage] + size + slack)
    order = np.lexsort((-score, lo, ix.owner[passage], doc[win]))
    key = np.stack([doc[win], ix.owner[passage], lo], 1)[order]
    order = order[np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])]      # one check per item and region
    order = order[hi[order] > lo[order]]
    whole = set()
    order = order[np.argsort(size[order], kind="stable")]                            # similar shapes together
    for s in range(0, len(order), 1024):
        part = order[s:s + 1024]
        its = [ix.items[k] for k in ix.owner[passage[part]]]
        regions = [w.hash[edge[doc[win[p]]] + lo[p]:edge[doc[win[p]]] + hi[p]] for p in part]
        got = lcs([i.words for i in its], regions)
        for p, item, region, n in zip(part, its, regions, got):
            share = n / len(item.words)
            fine, answer = _accepted(item, region, n, strict, loose)
            if fine:
                whole.add((doc[win[p]], ix.owner[passage[p]]))
                begin, end = _ends(item.words, region, int(n))
                yield (int(doc[win[p]]), item.item_id, int(n), float(share), float(score[p]), int(lo[p]) + begin, int(lo[p]) + end, answer)
    rest = np.array([size[p] > WINDOW and (doc[win[p]], ix.owner[passage[p]]) not in whole for p in range(len(win))])
    yield from _parts(w, b, ix, win[rest], passage[rest], score[rest], strict, loose)


def search(docs: DataFrame, ix: Index, cosine: float = COSINE, plain: float = PLAIN, strict: float = STRICT, loose: float = LOOSE,
           text_col: str = "text") -> DataFrame:
    """``KEY, doc_id`` and ``FOUND``: the best match of each document and item."""
    rows = docs.select(*c.row_key("doc_id", text_col), F.col("doc_id").cast("long"), c.text_of(text_col).alias("__text"))
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = weighted(ix.basis, ix.vocabulary, ix.idf)
        for batch in batches:
            best: dict[tuple, tuple] = {}
            for w in wd.words(batch.column("__text"), wd.LETTERS):
                for m in _search_slice(w, ix, scaled, cosine, plain, strict, loose) if len(w.hash) else ():
                    k = (w.first + m[0], m[1])
                    if k not in best or (m[2], m[4], -m[5]) > (best[k][1], best[k][3], -best[k][4]):
                        best[k] = m[1:]
            at = pa.array([k[0] for k in best], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(x).take(at) for x in (*c.KEY, "doc_id")]
                + [pa.array([m[k] for m in best.values()], kinds[k]) for k in range(len(names))], [*c.KEY, "doc_id", *names])

    return rows.mapInArrow(run, f"{c.KEY[0]} long, {c.KEY[1]} long, doc_id long, {FOUND}")


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = ITEMS, **options) -> DataFrame:
    """Matches of all documents with all items, from the whole method; ``benchmark`` has item_id, text and maybe answer."""
    answer = "answer" if "answer" in benchmark.columns else F.lit(None).cast("string").alias("answer")
    df, n = frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    spark, found, held = docs.sparkSession, [], []

    def flush():
        items = read_items(held)
        if items:
            ix = fit(docs, items, idf)
            found.append(search(docs, ix._replace(**dict(zip(("short", "rare", "rare_of"), _rarest(items, idf, options.get("loose", LOOSE))))), **options))
        held.clear()
    for r in benchmark.select("item_id", "text", answer).orderBy("item_id").toLocalIterator():
        held.append((r["item_id"], r["text"], r["answer"]))
        if len(held) == block:
            flush()
    flush()
    if not found:
        return spark.createDataFrame([], f"{c.KEY[0]} long, {c.KEY[1]} long, doc_id long, {FOUND}")
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item; the columns stay.

    The keys of leaking documents are written first, then removed by an anti join.
    """
    bad = c.stored(leaks(docs, benchmark, **options).select(*c.KEY).distinct(), "leaks")
    return docs.select("*", *c.row_key()).join(bad, list(c.KEY), "left_anti").drop(*c.KEY)


def op9_decontamination(spark, sf_dir):
    """Benchmark items found in all documents, by the best place of each document and item."""
    return leaks(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "benchmark")).drop(*c.KEY)


QUERIES = {"op9_decontamination": op9_decontamination}
