"""Toxicity as ordinal regression with cumulative links.

``P(grade <= k) = sigmoid(theta_k - w . x)``: one weight vector ``w`` for all thresholds ``theta_1 < theta_2 < ...``. The
features ``x`` are words and word beginnings, present or absent, of the whole text. The output is the expected grade.

Training takes every labelled document and every word of them (a caller may ask for fewer documents). The shrinkage of
the fit selects: the fit runs on a set of active words, then Spark computes the slope of every word at that fit, and words whose
slope is beyond the shrinkage join the set until there are none, which is the optimum over all words. Likelihood and slopes of a fit are sums that Spark
adds over the rows; the driver holds weights and slopes of active words only and takes the steps (``descend``). Scoring is a map over the scan without a shuffle.

The table of labels knows toxic or not, no severities. ``graded`` therefore grades a toxic document by the number of different
words clearly tied to toxicity: 1, 2, or 3 for more. ``fit`` itself takes any integer grades.

Defined cases: null and empty texts have no words and get the grade that the thresholds give an empty text; labels that are null
are not used, repeated labels of a document count once (the highest); without both kinds of label nothing is toxic;
an empty table gives an empty result; columns of the input named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import words as wd

SHRINKAGE = 2e-4        # weight of the absolute values of the weights beside the mean log-likelihood
SLACK = 0.02            # share of the shrinkage by which a slope must be beyond it, since a fit has an end
FIRST = 256             # words that the first step adds; each later step at most doubles them
STEPS = 60              # steps of one descent at most
PIECE = 1 << 16         # numbers of a fit's sums that are added together
DENSE = 1 << 20         # numbers of a block of rows whose curvature is added at once
TURNS = 3               # parts of the texts that are shuffled one after another, so that only one part's shuffle files are on disk
CLEAR = 4.0             # standard errors by which a word must go with toxicity to count for grading
TOP_GRADE = 3
BEGINNINGS = (4, 6)     # bytes of a word's beginning that are features of their own
OUTPUTS = "severity double, p_toxic double, grade int, toxic boolean"


class Model(NamedTuple):
    hashes: np.ndarray      # sorted word hashes, int64
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray      # grade values, one more than thresholds


def features(w: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all words and word beginnings."""
    parts = [(w.doc, w.hash), *(wd.beginnings(w, n) for n in BEGINNINGS)]
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts]).view(np.int64)


def _words_per_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[np.ndarray] = []
        for w in wd.words(batch.column("__text"), wd.LETTERS):
            doc, h = features(w)
            order = np.argsort(doc, kind="stable")
            edge, h = np.searchsorted(doc[order], np.arange(len(w.offsets))), h[order]
            out += [np.unique(h[edge[i]:edge[i + 1]]) for i in range(len(w.offsets) - 1)]
        lengths = np.array([len(x) for x in out], np.int64)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]),
                                              np.concatenate(out) if out else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("__tid"), batch.column("label"), lists.cast(pa.list_(pa.int64()))],
                                         ["__tid", "label", "words"])


def sample_words(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int | None = None) -> DataFrame:
    """``sid, label, words`` of the labelled documents, one row per different text with the highest of its labels.

    Which texts are labelled is found by numbers and hashes alone. Then equal texts meet, a part of all hashes at a time, and are words before the next part is shuffled.
    ``sample`` leaves only so many labelled documents, the first in hash order of their number.
    """
    ids = (labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy(F.col("doc_id").alias("__id")).agg(F.max(label_col).cast("int").alias("label")))
    if sample is not None:
        ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    tid = F.xxhash64(c.text_of()).alias("__tid")
    keys = docs.select("doc_id", tid).join(ids, F.col("doc_id") == F.col("__id")).groupBy("__tid").agg(F.max("label").alias("label"))
    keys, parts = c.stored(keys, "toxic-keys"), []                           # numbers only; texts are moved once
    for turn in range(TURNS):
        mine = F.pmod("__tid", F.lit(TURNS)) == turn
        texts = docs.select(tid, c.text_of().alias("__text")).where(mine).groupBy("__tid").agg(F.first("__text").alias("__text"))
        rows = texts.join(keys.where(mine).hint("merge"), "__tid")
        parts.append(c.stored(rows.mapInArrow(_words_per_doc, "__tid long, label int, words array<long>"), "toxic-words"))
    return reduce(DataFrame.union, parts).withColumnRenamed("__tid", "sid")


def _clear(rows: DataFrame, clear: float) -> DataFrame:
    """``word`` of all words that go with a positive label by ``clear`` standard errors or more."""
    n = rows.agg(F.coalesce(F.sum(F.when(F.col("label") > 0, 1)), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("all")).first()
    counts = rows.select(F.explode("words").alias("word"), (F.col("label") > 0).cast("int").alias("p"))
    counts = counts.groupBy("word").agg(F.sum("p").alias("pos"), F.count(F.lit(1)).alias("all"))
    a, b = F.col("pos") + 0.5, F.col("all") - F.col("pos") + 0.5
    odds = F.log(a / (n["pos"] - F.col("pos") + 0.5)) - F.log(b / (n["all"] - n["pos"] - (F.col("all") - F.col("pos")) + 0.5))
    return counts.where(odds / F.sqrt(1 / a + 1 / b) >= clear).select("word")


def graded(rows: DataFrame, clear: float = CLEAR) -> DataFrame:
    """``sid, grade, words``: 0 for what is not toxic, else the number of words clearly tied to toxicity, 1 at least and ``TOP_GRADE`` at most."""
    tied = np.array(sorted(r["word"] for r in c.stored(_clear(rows, clear), "toxic-clear").toLocalIterator()), np.int64)      # words that tell, no documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _ = _held(batch, tied)
            n, label = np.bincount(row, minlength=batch.num_rows), batch.column("label").to_numpy()
            grade = np.where(label <= 0, 0, np.clip(n, 1, TOP_GRADE)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(grade), batch.column("words")], ["sid", "grade", "words"])

    return rows.select("sid", "label", "words").mapInArrow(run, "sid long, grade int, words array<long>")


def _held(batch: pa.RecordBatch, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the sorted ``hashes``) of the words of a batch that are among them."""
    lists = batch.column("words")
    word, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    if not len(hashes):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
    hit = hashes[at] == word
    return row[hit], at[hit]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(doc: np.ndarray, feature: np.ndarray, n_features: int, grade: np.ndarray,
        rounds: int = 600, l1: float = SHRINKAGE, rate: float = 0.1, begin: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, thresholds, grades) from sparse binary rows, as pairs (document, feature), and a grade per document.

    Adam steps on the mean negative log-likelihood with shrinkage of the weights; thresholds stay ordered because their
    distances are fitted as exponentials. ``begin`` is a pair of weights and thresholds to go on from.
    """
    grades, y = np.unique(grade, return_inverse=True)
    k = len(grades)
    if k < 2:
        return np.zeros(n_features), np.zeros(0), grades
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    start, theta = begin or (np.zeros(n_features), np.log(share / (1 - share)))
    par = np.concatenate([start, theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    rows = np.arange(len(y))
    for t in range(1, rounds + 1):
        w, th = par[:n_features], np.cumsum(np.concatenate([par[n_features:n_features + 1], np.exp(par[n_features + 1:])]))
        s = np.bincount(doc, w[feature], minlength=len(y))
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        hi, lo = sigmoid(edge[y + 1] - s), sigmoid(edge[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        ds = (1 - hi - lo) / len(y)
        up, down = -hi * (1 - hi) / p / len(y), lo * (1 - lo) / p / len(y)
        dth = np.zeros(k + 1)
        np.add.at(dth, y[rows] + 1, up)
        np.add.at(dth, y[rows], down)
        dth = dth[1:k]
        rest = np.cumsum(dth[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, ds[doc], minlength=n_features), rest[:1], rest[1:] * np.exp(par[n_features + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        par = par - step
        w = par[:n_features]
        shrink = rate * l1 / (np.sqrt(v[:n_features] / (1 - 0.999 ** t)) + 1e-8)
        par[:n_features] = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    th = np.cumsum(np.concatenate([par[n_features:n_features + 1], np.exp(par[n_features + 1:])]))
    return par[:n_features], th, grades


def slopes(rows: DataFrame, model: Model, known: np.ndarray, beyond: float, most: int) -> list[int]:
    """The ``most`` steepest words of all rows, other than the ``known``, at which the slope of the mean log-likelihood is more than ``beyond``.

    The slope of a word is the sum over the rows that hold it; partial sums are added in Spark. A word in fewer than ``beyond`` times
    all rows cannot get there, since a row adds at most one to the sum.
    """
    n = rows.count()
    edge = np.concatenate([[-np.inf], model.thresholds, [np.inf]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            word, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            held, at = _held(batch, model.hashes)
            s = np.bincount(held, model.weights[at], minlength=len(size)) if len(model.hashes) else np.zeros(len(size))
            y = np.searchsorted(model.grades, batch.column("grade").to_numpy())
            slope = 1 - sigmoid(edge[y + 1] - s) - sigmoid(edge[y] - s)
            words, inverse = np.unique(word, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bincount(inverse, slope[row], minlength=len(words))),
                                              pa.array(np.bincount(inverse, minlength=len(words)))], ["word", "slope", "n"])

    sums = rows.select("grade", "words").mapInArrow(run, "word long, slope double, n long").groupBy("word").agg(F.sum("slope").alias("slope"), F.sum("n").alias("n"))
    steep = sums.where((F.col("n") >= beyond * n) & (F.abs("slope") > beyond * n)).orderBy(F.abs("slope").desc(), "word")
    found = [r["word"] for r in c.collected(steep.limit(most + len(known)))]
    own = set(known.tolist())
    return [x for x in found if x not in own][:most]


def _active(rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``grade, at, n``: the places in ``hashes`` of each row's active words, as bytes, and how many rows are the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = _held(batch, hashes)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            at = at.astype(np.int32)
            parts = pa.array([at[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("grade"), parts], ["grade", "at"])

    return rows.select("grade", "words").mapInArrow(run, "grade int, at binary").groupBy("grade", "at").agg(F.count(F.lit(1)).alias("n"))


def summed(active: DataFrame, grades: np.ndarray, n_words: int) -> Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """The mean negative log-likelihood of all rows, its slope, and its curvature for some words and the thresholds, as a function of weights
    and thresholds (one array) and of those words' places."""
    k, total = len(grades), active.agg(F.sum("n")).first()[0]

    def value(par: np.ndarray, some: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        wide = len(some) + k + 1                                  # the outer edges, which do not move, are left out in the end
        col = np.full(n_words, -1)
        col[some] = np.arange(len(some))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edge = np.concatenate([[-np.inf], par[n_words:], [np.inf]])
            out, curve = np.zeros(1 + n_words + k + 1), np.zeros((wide, wide))
            for batch in batches:
                lists = batch.column("at").cast(pa.large_binary())
                offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset:lists.offset + batch.num_rows + 1] // 4
                feature = np.frombuffer(lists.buffers()[2] or b"", np.int32)[offsets[0]:offsets[-1]]
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                y, n = np.searchsorted(grades, batch.column("grade").to_numpy()), batch.column("n").to_numpy()
                t = np.bincount(row, par[feature], minlength=len(y))
                hi, lo = sigmoid(edge[y + 1] - t), sigmoid(edge[y] - t)
                p, up, down = np.maximum(hi - lo, 1e-12), hi * (1 - hi), lo * (1 - lo)
                out[0] -= n @ np.log(p)
                out[1:1 + n_words] += np.bincount(feature, (n * (1 - hi - lo))[row], minlength=n_words)
                out[1 + n_words:] += np.bincount(y, n * down / p, minlength=k + 1) - np.bincount(y + 1, n * up / p, minlength=k + 1)
                w = len(some)
                np.add.at(curve, (w + y + 1, w + y + 1), n * ((up / p) ** 2 - up * (1 - 2 * hi) / p))
                np.add.at(curve, (w + y, w + y), n * ((down / p) ** 2 + down * (1 - 2 * lo) / p))
                np.add.at(curve, (w + y, w + y + 1), -n * up * down / p ** 2)
                np.add.at(curve, (w + y + 1, w + y), -n * up * down / p ** 2)
                held = np.flatnonzero(col[feature] >= 0)
                at, row = col[feature[held]], row[held]
                for side, d in ((1, up), (0, down)):
                    cross = np.zeros((w, k + 1))
                    np.add.at(cross, (at, y[row] + side), -(n * d)[row])
                    curve[:w, w:] += cross
                    curve[w:, :w] += cross.T
                step = max(1, DENSE // max(1, w))
                for s in range(0, len(y), step):
                    i, j = np.searchsorted(row, [s, s + step])
                    x = np.zeros((min(step, len(y) - s), w))
                    x[row[i:j] - s, at[i:j]] = 1
                    curve[:w, :w] += x.T @ (x * (n * (up + down))[s:s + step, None])
            flat = np.concatenate([out, curve.ravel()])
            starts = np.arange(0, len(flat), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array([flat[s:s + PIECE].tobytes() for s in starts], pa.binary())], ["first", "part"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p) for p in pdf["part"])
            return pd.DataFrame({"first": pdf["first"][:1], "part": [total.tobytes()]})

        shape, flat = "first long, part binary", np.zeros(1 + n_words + k + 1 + wide * wide)
        for r in c.collected(active.mapInArrow(run, shape).groupBy("first").applyInPandas(add, shape)):      # a number per active word and pair of some
            part = np.frombuffer(r["part"])
            flat[r["first"]:r["first"] + len(part)] = part
        got, curve = flat[:1 + n_words + k + 1], flat[1 + n_words + k + 1:].reshape(wide, wide)
        inner = np.r_[:len(some), len(some) + 1:wide - 1]
        return got[0] / total, np.concatenate([got[1:1 + n_words], got[2 + n_words:1 + n_words + k]]) / total, curve[np.ix_(inner, inner)] / total

    return value


def _shrunk(x: np.ndarray, g: np.ndarray, curve: np.ndarray, n_words: int, l1: float, rounds: int = 200) -> np.ndarray:
    """The minimum of a quadratic form around ``x`` and of the shrinkage of its first ``n_words``, by coordinates."""
    new, slope, flat = x.copy(), g.copy(), np.diag(curve) + 1e-9
    for _ in range(rounds):
        most = 0.0
        for j in range(len(x)):
            to = new[j] - slope[j] / flat[j]
            if j < n_words:
                to = np.sign(to) * max(abs(to) - l1 / flat[j], 0.0)
            if to != new[j]:
                most, d = max(most, abs(to - new[j]) * flat[j]), to - new[j]
                slope += curve[j] * d
                slope[j] += 1e-9 * d
                new[j] = to
        if most <= 1e-3 * l1:
            break
    return new


def descend(value: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], par: np.ndarray, n_words: int, l1: float,
            slack: float = SLACK, steps: int = STEPS, first: np.ndarray | None = None) -> np.ndarray:
    """The minimum of ``value`` and ``l1`` times the absolute values of the first ``n_words`` parameters, by Newton steps with shrinkage.

    It is reached where no slope, shrinkage taken off, is more than ``slack`` times ``l1``. Words that are 0 and whose slope is within the shrinkage wait; ``first`` names the words of the first step.
    """
    some = np.arange(n_words) if first is None else first
    f, g, curve = value(par, some)
    f += l1 * np.abs(par[:n_words]).sum()
    for _ in range(steps):
        w, gw = par[:n_words], g[:n_words]
        left = np.where(w != 0, gw + l1 * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - l1, 0))
        if max(np.abs(left).max(initial=0), np.abs(g[n_words:]).max()) <= slack * l1:
            break
        mine = np.concatenate([some, np.arange(n_words, len(par))])
        way = np.zeros(len(par))
        way[mine] = _shrunk(par[mine], g[mine], curve, len(some), l1) - par[mine]
        want = g @ way + l1 * (np.abs((par + way)[:n_words]).sum() - np.abs(w).sum())
        following = np.flatnonzero((w + way[:n_words] != 0) | (np.abs(gw) > 0.9 * l1))
        size = 1.0
        while True:
            new = par + size * way
            if (np.diff(new[n_words:]) > 0).all():
                f_new, g_new, c_new = value(new, following)
                f_new += l1 * np.abs(new[:n_words]).sum()
                if f_new <= f + 1e-4 * size * want:
                    break
            size /= 2
            if size < 1e-6:
                if len(some) == n_words:
                    return par
                new, following = par, np.arange(n_words)         # with the curvature of all words
                f_new, g_new, c_new = value(new, following)
                f_new += l1 * np.abs(new[:n_words]).sum()
                break
        par, f, g, curve, some = new, f_new, g_new, c_new, following
    return par


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int | None = None, clear: float = CLEAR,
          l1: float = SHRINKAGE) -> Model:
    """Grade, then fit and add the steepest words, as many as there are, until no word of the labelled documents would change the fit."""
    rows = graded(sample_words(docs, labels, label_col, sample), clear)
    counts = sorted((r["grade"], r["n"]) for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect())      # a row per grade
    grades, n = np.array([g for g, _ in counts], np.int64), np.array([n for _, n in counts], float)
    hashes, weights = np.zeros(0, np.int64), np.zeros(0)
    if len(grades) < 2 or grades[0] != 0:                      # not both kinds of label
        return Model(hashes, weights, np.zeros(0), np.zeros(1, np.int64))
    share = np.cumsum(n)[:-1] / n.sum()
    thresholds = np.log(share / (1 - share))
    while True:
        used = weights != 0
        model = Model(hashes[used], weights[used], thresholds, grades)
        more = slopes(rows, model, hashes, l1 * (1 + SLACK), max(FIRST, len(hashes)))
        if not more:
            return model
        before, hashes = hashes, np.array(sorted({*hashes.tolist(), *more}), np.int64)
        start = np.zeros(len(hashes))
        start[np.searchsorted(hashes, before)] = weights
        start = np.concatenate([start, thresholds])
        active = c.stored(_active(rows, hashes), "toxic-active")
        par = descend(summed(active, grades, len(hashes)), start, len(hashes), l1, first=np.flatnonzero((start[:len(hashes)] != 0) | np.isin(hashes, more)))
        weights, thresholds = par[:len(hashes)], par[len(hashes):]


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, at: float = 0.5,
          prefix: str = "") -> DataFrame:
    """``keep`` (all) columns of every document with ``severity`` (the expected grade), ``p_toxic`` (the chance
    of any grade above the lowest), ``grade`` (the likeliest) and ``toxic`` (``p_toxic`` of ``at`` or more), all with ``prefix``."""
    names = [prefix + f.split()[0] for f in OUTPUTS.split(", ")]
    keep = [x for x in (docs.columns if keep is None else keep) if x not in names]
    kept = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in keep)
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for w in wd.words(batch.column(text_col), wd.LETTERS):
                if len(model.hashes) and len(w.hash):
                    doc, h = features(w)
                    at_ = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
                    hit = np.flatnonzero(model.hashes[at_] == h)
                    pair = np.unique(doc[hit] * len(model.hashes) + at_[hit])         # present or absent
                    np.add.at(s, w.first + pair // len(model.hashes), model.weights[pair % len(model.hashes)])
            upto = sigmoid(model.thresholds[None, :] - s[:, None])
            p = np.diff(upto, prepend=0.0, append=1.0, axis=1)
            severity, p_toxic = p @ model.grades, 1 - p[:, 0] if len(model.thresholds) else np.zeros(len(s))
            grade = model.grades[p.argmax(axis=1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in keep] + [pa.array(severity), pa.array(p_toxic), pa.array(grade), pa.array(p_toxic >= at)],
                keep + names)

    return rows.mapInArrow(run, f"{kept}, " + ", ".join(prefix + f for f in OUTPUTS.split(", ")))


def op7_toxicity(spark, sf_dir):
    """Expected severity of all documents, trained on the given labels."""
    docs = c.read(spark, sf_dir, "documents")
    return score(docs, train(docs, c.read(spark, sf_dir, "labels")), keep=["doc_id"])


QUERIES = {"op7_toxicity": op7_toxicity}
