"""Ordinal regression: thresholds, gradients and held-out accuracy; the query beside plain Python and the fit beside another optimiser."""

import math
import pathlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panoloom.llm import common, toxicity
from panoloom.llm import words as wd

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=0):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(400)]
    bad = ["nasty", "vile", "loweiab", "loweicd", "loweief"]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(bad[:2] + [f"lowei{rng.randrange(99)}"])
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, documents):
    docs, labels = corpus(800)
    df = documents(docs + [(1000, "nasty vile loweixy and word1"), (1001, None), (1002, ""), (1003, "word2 " * 30_000), (1003, "word2 " * 30_000)])
    model = toxicity.train(df, spark.createDataFrame(labels[:500], LABELS))
    got = {r.doc_id: r for r in toxicity.score(df, model, keep=["doc_id"]).collect()}
    wrong = sum(got[i].toxic != bool(y) for i, _, y in labels[500:])
    assert wrong <= 6
    assert got[1000].toxic and got[1000].severity > 1.5
    assert not any(got[i].toxic for i in (1001, 1002, 1003)) and got[1001].severity == got[1002].severity
    assert all(0 <= r.severity <= toxicity.TOP_GRADE for r in got.values())
    assert toxicity.score(df, model).count() == len(docs) + 5


def test_order_of_grades():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4)) < 0.4
    grade = np.minimum(x[:, 0].astype(int) + x[:, 1] + x[:, 2], 3)
    doc, feature = np.nonzero(x)
    w, th, grades = toxicity.fit(doc, feature, 4, grade)
    assert (np.diff(th) > 0).all() and list(grades) == [0, 1, 2, 3]
    assert w[:3].min() > 1 and abs(w[3]) < 0.3
    s = x @ w
    p = np.diff(toxicity.sigmoid(th[None] - s[:, None]), prepend=0, append=1, axis=1)
    assert (p.argmax(axis=1) == grade).mean() > 0.97


def test_missing_labels_and_tables(spark, documents):
    docs, labels = corpus(40)
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1), (7, 0, 0), (7, 1, 0)], LABELS)
    df = documents(docs).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "label")
    rows = toxicity.score(df, toxicity.train(df, none)).collect()
    assert len(rows) == 40 and not any(r.toxic for r in rows) and all(r.severity == 0 for r in rows)
    empty = documents([])
    assert toxicity.score(empty, toxicity.train(empty, spark.createDataFrame(labels, LABELS))).collect() == []
    assert toxicity.score(df, toxicity.train(df, spark.createDataFrame([], LABELS))).count() == 40


def test_sample_is_bounded(spark, documents):
    docs, labels = corpus(60)
    got = toxicity.sample_words(documents(docs), spark.createDataFrame(labels * 2, LABELS), sample=25)
    assert got.count() == 25


def parts(text):
    """Words (0, bytes) and their beginnings (length, bytes), each with one word that has it."""
    lower = "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text or "")
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", lower.encode())
    return {**{(0, w): w for w in words}, **{(n, w[:n]): w for w in words for n in toxicity.BEGINNINGS if len(w) > n}}


def likelihood(x, y, w, theta):
    """Mean negative log-likelihood of the grades, in plain Python."""
    edge = [-math.inf, *theta, math.inf]
    total = 0.0
    for row, k in zip(x, y):
        s = sum(w[j] for j in row)
        total -= math.log(max(1e-300, 1 / (1 + math.exp(-(edge[k + 1] - s))) - (1 / (1 + math.exp(-(edge[k] - s))) if k else 0.0)))
    return total / len(y)


def descended(x, y, n, classes, l1, rounds=4000):
    """Another optimiser: proximal descent with a backtracked step on weights and thresholds, slopes by differences of the exact sums."""
    rows = np.zeros((len(y), n))
    for i, r in enumerate(x):
        rows[i, list(r)] = 1
    y = np.array(y)

    def value(w, th):
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        s = rows @ w
        p = 1 / (1 + np.exp(-(edge[y + 1] - s))) - 1 / (1 + np.exp(-(edge[y] - s)))
        return -np.log(np.maximum(p, 1e-300)).mean()

    def slope(w, th):
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        s = rows @ w
        hi, lo = 1 / (1 + np.exp(-(edge[y + 1] - s))), 1 / (1 + np.exp(-(edge[y] - s)))
        p = hi - lo
        gw = rows.T @ ((hi * (1 - hi) - lo * (1 - lo)) / p) / len(y)
        gt = np.array([((y == k + 1) * lo * (1 - lo) / p - (y == k) * hi * (1 - hi) / p).mean() for k in range(len(th))])
        return gw, gt
    share = np.cumsum(np.bincount(y, minlength=classes))[:-1] / len(y)
    w, th, step = np.zeros(n), np.log(share / (1 - share)), 1.0
    for _ in range(rounds):
        gw, gt = slope(w, th)
        while True:
            v = w - step * gw
            v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
            t = th - step * gt
            d = np.concatenate([v - w, t - th])
            if (np.diff(t) > 0).all() and value(v, t) <= value(w, th) + np.concatenate([gw, gt]) @ d + d @ d / (2 * step) + 1e-13:
                break
            step /= 2
        w, th, step = v, t, step * 1.3
    return w, th


def test_fit_beside_another_optimiser():
    rng = random.Random(5)
    x = [sorted(rng.sample(range(12), rng.randrange(1, 6))) for _ in range(300)]
    y = [min(2, (0 in r) + (1 in r) + (rng.random() < .1)) for r in x]
    l1 = 5e-3
    doc = np.array([i for i, r in enumerate(x) for _ in r])
    w, th, _ = toxicity.fit(doc, np.array([j for r in x for j in r]), 12, np.array(y), rounds=3000, l1=l1, rate=0.02)
    other, other_th = descended(x, y, 12, 3, l1)
    mine, best = (likelihood(x, y, a, b) + l1 * np.abs(a).sum() for a, b in ((w, th), (other, other_th)))
    assert mine <= best + 2e-4
    assert np.abs(w - other).max() < 0.1 and np.abs(th - other_th).max() < 0.1


def test_no_word_of_the_sample_is_left_out(spark, documents, monkeypatch):
    """At the fit, the slope of every word that is not used is within the shrinkage, however few words a step adds."""
    monkeypatch.setattr(toxicity, "FIRST", 3)
    docs, labels = corpus(300, 3)
    l1 = 2e-3
    model = toxicity.train(documents(docs), spark.createDataFrame(labels, LABELS), l1=l1)
    seen = set().union(*(parts(t) for _, t in docs))
    rows = toxicity.graded(toxicity.sample_words(documents(docs), spark.createDataFrame(labels, LABELS))).collect()
    known = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    slope, edge = Counter(), [-math.inf, *model.thresholds, math.inf]
    for r in rows:
        s, k = sum(known.get(h, 0.0) for h in r.words), model.grades.tolist().index(r.grade)
        for h in r.words:
            slope[h] += 1 - 1 / (1 + math.exp(-(edge[k + 1] - s))) - (1 / (1 + math.exp(-(edge[k] - s))) if k else 0.0)
    assert len(slope) == len(seen)
    left = [v for h, v in slope.items() if h not in known]
    assert known and max(map(abs, left)) <= l1 * (1 + 3 * toxicity.SLACK) * len(rows)


def test_query_beside_plain_python(spark, small):
    docs = common.read(spark, small, "documents")
    model = toxicity.train(docs, common.read(spark, small, "labels"))
    number = {}

    def number_of(part, word):
        """The hash of a part, looked up once in a text of one word."""
        if part not in number:
            got = next(iter(wd.words(pa.array([word.decode()], pa.large_string()), wd.LETTERS)))
            number[part] = int((wd.beginnings(got, part[0])[1] if part[0] else got.hash).view(np.int64)[0])
        return number[part]
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, small).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        s = sum(weight.get(number_of(*p), 0.0) for p in parts(r.text).items())
        upto = [1 / (1 + math.exp(-(t - s))) for t in model.thresholds] + [1.0]
        p = [b - a for a, b in zip([0.0, *upto], upto)]
        mine = got[r.doc_id]
        assert mine.severity == pytest.approx(sum(a * g for a, g in zip(p, model.grades.tolist())), abs=1e-9)
        assert mine.p_toxic == pytest.approx(1 - p[0], abs=1e-9)
        assert mine.toxic == (mine.p_toxic >= 0.5) and p[model.grades.tolist().index(mine.grade)] >= max(p) - 1e-9


def test_every_labelled_document_takes_part(spark, documents):
    """More labelled documents than the sample once held; what only few of them hold is learnt as well, and slopes are sums over all."""
    n = 20_600
    docs = [(i, f"plain{i % 50} " + (f"vile plain{i % 7}" if i % 5 == 0 else "fine")) for i in range(n)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(n)]
    assert toxicity.sample_words(documents(docs), spark.createDataFrame(labels, LABELS)).agg({"label": "sum"}).first()[0] == len({t for _, t in docs if "vile" in t})
    apart = [(i, f"note {i} " + ("vile" if i % 5 == 0 else "fine")) for i in range(n)]
    assert toxicity.sample_words(documents(apart), spark.createDataFrame(labels, LABELS)).count() == n


def test_summed_fit_beside_another_optimiser(spark, monkeypatch):
    rng = random.Random(6)
    x = [sorted(rng.sample(range(12), rng.randrange(0, 6))) for _ in range(300)]
    y = [min(2, (0 in r) + (1 in r) + (rng.random() < .1)) for r in x]
    l1 = 5e-3
    rows = spark.createDataFrame([(i, g, [int(j) for j in r]) for i, (r, g) in enumerate(zip(x, y))], "sid long, grade int, words array<long>")
    monkeypatch.setattr(toxicity, "PIECE", 7)
    active = common.stored(toxicity._active(rows.repartition(3), np.arange(12)), "active")
    share = np.cumsum(np.bincount(y))[:-1] / len(y)
    theta = np.log(share / (1 - share))
    par = toxicity.descend(toxicity.summed(active, np.arange(3), 12), np.concatenate([np.zeros(12), theta]), 12, l1)
    w, th = par[:12], par[12:]
    other, other_th = descended(x, y, 12, 3, l1)
    mine, best = (likelihood(x, y, a, b) + l1 * np.abs(a).sum() for a, b in ((w, th), (other, other_th)))
    assert mine <= best + 2e-5
    assert np.abs(w - other).max() < 0.1 and np.abs(th - other_th).max() < 0.1


def test_training_leaves_no_shuffle_files(spark, documents):
    """What a step of the training shuffles goes when it ends, since many steps together are more than the texts."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {p for folder in manager.localDirsString() for p in pathlib.Path(folder).rglob("shuffle_*.data")}
    docs, labels = corpus(400)
    before = shuffled()
    model = toxicity.train(documents(docs), spark.createDataFrame(labels, LABELS))
    assert len(model.hashes)
    assert sum(p.stat().st_size for p in shuffled() - before) < 100_000


def test_equal_texts_meet_in_one_turn(spark, documents):
    """Copies with and without labels, null numbers and null texts: one row a labelled text, with the highest label."""
    docs = [(k, f"text {k % 7} of seven") for k in range(60)] + [(None, "text 1 of seven"), (100, None), (101, ""), (102, "no label")]
    labels = [(k, 1, int(k == 9)) for k in range(20)] + [(100, 1, 0), (101, 1, 1), (102, 1, None), (None, 1, 1)]
    rows = toxicity.sample_words(documents(docs * 2), spark.createDataFrame(labels * 2, LABELS)).collect()
    assert sorted((len(r["words"]), r["label"]) for r in rows) == [(0, 1), *[(5, 0)] * 6, (5, 1)]
    assert len({r["sid"] for r in rows}) == 8
