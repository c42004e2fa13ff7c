"""Benchmark decontamination beside a search for whole items, and its parts beside plain loops."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from panoloom.llm import decontam as dc
from panoloom.llm import words as wd

BENCH = "item_id long, text string"


def norm(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def found(df, bench, **options):
    return sorted({(r.doc_id, r.item_id) for r in dc.leaks(df, bench, **options).collect()})


def test_real_documents(spark, small, documents, real):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = sorted((d, i) for d, t in real for i, x in items if x in norm(t))
    assert found(documents(real), bench) == want and want


def make(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefg')}{rng.randrange(900)}" for _ in range(n)]


def test_paraphrases_parts_and_blocks(spark, documents):
    items = [(k, " ".join(make(100 + k, 15 + 4 * k))) for k in range(8)]
    docs, want = [], []
    for k, (i, t) in enumerate(items):
        w = t.split()
        few = [x if j % 7 != 3 else "other" for j, x in enumerate(w)]
        docs.append((k, " ".join(make(k, 70) + few + make(50 + k, 90))))
        want.append((k, i))
        docs.append((100 + k, " ".join(make(200 + k, 200) + w[:len(w) // 3])))     # a third is no leak
        docs.append((200 + k, " ".join(make(300 + k, 40) + w)))
        want.append((200 + k, i))
    docs += [(300 + k, " ".join(make(400 + k, 300))) for k in range(40)]
    bench = spark.createDataFrame(items, BENCH)
    assert found(documents(docs), bench) == sorted(want)
    assert found(documents(docs), bench, block=3) == sorted(want)
    kept = dc.clean(documents(docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_corner_cases(spark, documents):
    t = " ".join(make(1, 30))
    rows = [(1, None), (2, ""), (3, t), (3, t), (4, "x" * 50_000), (5, " ".join(make(9, 30_000)) + " " + t), (None, t.upper())]
    df = documents(rows).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "coverage")
    bench = spark.createDataFrame([(1, t), (2, None), (3, ""), (None, t), (4, "?!")], BENCH)
    got = dc.leaks(df, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "5", "None"] and {r.item_id for r in got} == {1}
    assert dc.leaks(df, spark.createDataFrame([], BENCH)).collect() == []
    assert dc.leaks(documents([]), bench).collect() == []


def test_answer_decides_loose_matches(spark, documents):
    w = make(3, 40)
    loose = [x if k % 3 else "gone" for k, x in enumerate(w)]
    df = documents([(1, " ".join(loose))] + [(k, " ".join(make(k, 200))) for k in range(10, 30)])
    answers = "item_id long, text string, answer string"
    assert found(df, spark.createDataFrame([(1, " ".join(w), " ".join(w[1:3]))], answers)) == [(1, 1)]
    assert found(df, spark.createDataFrame([(1, " ".join(w), "something else")], answers)) == []


def test_subsequences():
    rng = random.Random(1)
    a = [np.array([rng.randrange(2, 6) for _ in range(rng.randrange(1, 12))], np.uint64) for _ in range(80)]
    b = [np.array([rng.randrange(2, 6) for _ in range(rng.randrange(1, 15))], np.uint64) for _ in range(80)]
    for x, y, got in zip(a, b, dc.lcs(a, b)):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        assert got == t[-1][-1]


def test_ends_of_subsequences():
    rng = random.Random(5)
    for _ in range(300):
        item, region = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        n = longest(item, region)
        if not n:
            continue
        begin, end = dc._ends(np.array(item), np.array(region), n)
        assert end == next(j for j in range(len(region) + 1) if longest(item, region[:j]) == n)
        assert longest(item, region[begin:end]) == n > longest(item, region[begin + 1:end])


def test_spans_are_the_planted_places(spark, documents):
    item = ["the"] + make(11, 20) + ["of", "the"] + make(12, 12)
    after = " and so the end of the story of the".split()
    long = make(13, 120)
    texts = [(1, make(1, 8) + item + after), (2, ["the"] + make(2, 3) + item[:-1] + ["the"] * 5), (3, make(3, 50) + long[30:60] + make(4, 50)), (4, make(5, 200))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (3, " ".join(item[1:9]))], BENCH)
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in dc.leaks(documents([(d, " ".join(t)) for d, t in texts]), bench).collect()}
    assert got[1, 1] == (8, 8 + len(item)) and got[1, 3] == (9, 17)
    assert got[2, 1] == (4, 4 + len(item) - 1)
    assert 50 <= got[3, 2][0] < got[3, 2][1] <= 80 and not any(d == 4 for d, _ in got)


def test_words_of_a_batch():
    texts = ["One, two\tthree", None, "", "  ", "Été à la plage", "x" * 3_000_000, "tail end"]
    seen = []
    for w in wd.words(pa.array(texts), wd.LETTERS):
        for d, s, e in zip(w.doc, w.start, w.end):
            seen.append((w.first + int(d), w.data[s:e].tobytes().decode()))
    assert seen == [(k, x) for k, t in enumerate(texts) for x in re.findall(r"\w+", (t or "").lower())]


def changed(words, share, seed):
    rng = random.Random(seed)
    gone = set(rng.sample(range(len(words)), int(share * len(words))))
    return [f"z{rng.randrange(10 ** 6)}" if k in gone else x for k, x in enumerate(words)]


def longest(a, b):
    return int(dc.lcs([np.array([hash(x) % 2 ** 61 + 2 for x in a], np.uint64)], [np.array([hash(x) % 2 ** 61 + 2 for x in b], np.uint64)])[0])


def test_recall_of_changed_and_partial_items(spark, documents):
    """Final rows beside the whole LCS of item and document; figures are printed."""
    items = [(k, ". ".join(" ".join(w[s:s + 14]) for s in range(0, len(w), 14))) for k, w in enumerate(make(900 + k, 40 + 8 * k) for k in range(20))]
    docs, want = [], {}
    for i, t in items:
        w = t.replace(".", "").split()
        for c, part in enumerate([*(changed(w, x / 100, 7 * i + x) for x in (0, 15, 30, 40)), w[:len(w) * 3 // 4], w[len(w) // 4:len(w) // 4 + 30],
                                  w[:8]]):
            d = 100 * c + i
            docs.append((d, " ".join(make(2000 + d, 90) + part + make(5000 + d, 90))))
            n = longest(w, docs[-1][1].split())
            if n >= dc.LOOSE * len(w) if c < 5 else c == 5:
                want.setdefault(c, set()).add((d, i))
    got = set(found(documents(docs), spark.createDataFrame(items, BENCH)))
    print({name: (len(want.get(c, set()) & got), len(want.get(c, set())), sum(d // 100 == c for d, _ in got))
           for c, name in enumerate(["0 %", "15 %", "30 %", "40 %", "first 3/4", "30 words", "8 words"])})
    assert not [m for c in want for m in want[c] - got]
    assert all(d < 600 and d % 100 == i for d, i in got)


def test_short_items_between_rare_words(spark, documents):
    """Items of 6 to 31 words, of frequent words, between rare ones and between other words of the benchmark."""
    rng = random.Random(4)
    often = [f"w{k}" for k in range(400)]
    items = [(n, " ".join(rng.choice(often) for _ in range(n))) for n in (6, 7, 8, 10, 12, 16, 20, 24, 28, 30, 31)]
    rare = [(900 + k, " ".join(f"rare{k}x{j}" for j in range(40))) for k in range(3)]
    docs, want = [(k, " ".join(rng.choice(often) for _ in range(300))) for k in range(5000, 5200)], []
    for shift in range(8):
        for n, t in items:
            d = 100 * shift + n
            around = rare[shift % 3][1].split() if shift % 2 else [f"id{rng.randrange(10 ** 9)}" for _ in range(40)]
            rng.shuffle(around)
            docs.append((d, " ".join(around[:8 + shift] + t.split() + around[16:30 + shift])))
            want.append((d, n))
    got = set(found(documents(docs), spark.createDataFrame(items + rare, BENCH)))
    print(len(got & set(want)), "of", len(want))
    assert not set(want) - got and {m for m in got if m[1] < 900} == set(want)


def test_basis_sees_every_document(spark, documents, monkeypatch):
    """More documents than the sample once held: the basis turns the covariance of all their windows and the items' passages into the unit matrix."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(4_600)]
    items = [(k, " ".join(rng.choice(words[:40]) for _ in range(30))) for k in range(12)]
    seen, fit = [], dc.fit
    monkeypatch.setattr(dc, "fit", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    dc.leaks(documents(texts), spark.createDataFrame(items, "item_id long, text string"))
    ix, = seen
    number = {int(h): k for k, h in enumerate(ix.vocabulary)}

    def rows(texts, span):
        out = []
        for w in wd.words(pa.array(texts, pa.large_string()), wd.LETTERS):
            edge = w.per_doc()
            for a, b in zip(edge[:-1], edge[1:]):
                for s in range(a, b, dc.BLOCK) if span is None else range(a, max(a + 1, b - dc.WINDOW + dc.BLOCK), dc.BLOCK):
                    vector, mass = np.zeros(len(number)), 0.0
                    for h in w.hash[s:min(b, s + dc.WINDOW)]:
                        weight = ix.idf[int(h) % dc.SLOTS]
                        if int(h) in number:
                            vector[number[int(h)]] += weight
                        mass += weight ** 2
                    out.append(vector / math.sqrt(mass))
        return np.array(out)
    corpus, own = rows(texts, None), rows([t for _, t in items], 0)
    both = corpus.T @ corpus / len(corpus) + own.T @ own / len(own)
    basis = ix.basis.astype(float)
    assert np.abs(basis.T @ both @ basis - np.eye(basis.shape[1])).max() < 1e-3


def test_covariance_does_not_depend_on_word_slices(monkeypatch):
    """Words come in small slices, for memory; the products of rows stay those of a megabyte, to the bit."""
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"W{k}" for k in rng.integers(0, 300, n)) for n in rng.integers(0, 400, 200)], pa.string())
    vocabulary = np.unique(np.concatenate([w.hash for w in wd.words(texts, wd.LETTERS)]))[::2]
    idf = rng.uniform(1, 9, dc.SLOTS)
    rows = dc.weighted(rng.standard_normal((len(vocabulary), 12)).astype(np.float32), vocabulary, idf)
    whole, n = dc._covariance(texts, dc.lookup(vocabulary), idf, rows)
    monkeypatch.setattr(wd, "WORD_BYTES", 3000)
    parts, m = dc._covariance(texts, dc.lookup(vocabulary), idf, rows)
    assert n == m and (whole == parts).all() and whole.any()
