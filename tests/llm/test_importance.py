"""Resampling beside plain counting of word runs as strings."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panoloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, order):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, order=1, buckets=10_000, percent=10, least=20):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, order)[1])
    s, t = counts(r[1] for r in rows), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for k, (i, text) in enumerate(rows):
        words, f = features(text, order)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words) >= least:
            fit.append(((-score, i is None, i or 0), k))
    for place, (_, k) in enumerate(sorted(fit)[:len(fit) * percent // 100]):
        out[k][4] = place + 1
    return sorted(map(tuple, out), key=str)


def result(docs, target, **options):
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in importance.resample(docs, target, **options).select(*cols).collect()), key=str)


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize(("order", "buckets"), [(1, 10_000), (3, 500)])
def test_real_documents(spark, documents, real, order, buckets):
    target = [t for _, t in real[::9]] + [None, "Übung und THE end"]
    assert result(documents(real), target_of(spark, target), order=order, buckets=buckets) == brute(real, target, order, buckets)


def test_corner_cases(spark, documents):
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "délta", "日本", "x1", "İ", "k-k", "a_b", " ", "\x85", "q" * 3000]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "\x00", "  "]) for _ in range(n))
    rows = [(i, make(rng.randrange(60))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " .,"), (None, make(40)), (103, "one " * 19), (104, "one " * 20), (105, make(4000)), (5, rows[5][1]), (5, rows[5][1]),
             (106, "z" * 5000), (107, "-".join(["y" * 2000] * 3))]
    target = [make(30), "", None]
    assert result(documents(rows), target_of(spark, target), percent=40) == brute(rows, target, percent=40)
    assert result(documents(rows), target_of(spark, []), percent=100) == brute(rows, [], percent=100)
    assert result(documents([]), target_of(spark, target)) == []


def test_clashing_columns(spark):
    rows = [(i, "some words here and there " * 5, 7.5, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, tid string")
    assert result(df, target_of(spark, ["words"])) == brute([r[:2] for r in rows], ["words"])


def test_composed_codes_equal_codes_of_strings():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randrange(200)), rng.randbytes(rng.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    joined = importance.appended(a, b, np.array([len(p[1]) for p in pairs]))
    assert joined.tolist() == [zlib.crc32(x + y) for x, y in pairs]


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_pieces_of_texts(piece):
    texts = ["one Two three", "", None, "zéro " * 50, "w" * 2500 + " tail", "end"]
    rows, found = [], []
    for first, _, _, row, bucket in importance.scan(pa.array(texts), 2, 10_000, piece):
        rows += (row + first).tolist()
        found += bucket.tolist()
    want = sorted((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t, 2)[1])
    assert sorted(zip(rows, found)) == want


def test_payloads_hold_numbers_only():
    """The places of words come as numbers one after another; a list of pairs of Python objects takes time and memory of its own."""
    n = 100_000
    text = b" " + b" ".join(b"w%d" % (k % 50) for k in range(n)) + b" "
    tracemalloc.start()
    place, crc, size = importance.payloads(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(place) == n and crc[7] == zlib.crc32(b"w7") and size[49] == 3
    assert peak < 85 * n


def test_piece_borders_change_nothing():
    texts = pa.array(["one two, three " * 40, None, "x" * 300 + " Ärger", "", "one"] * 3)

    def flat(piece):
        parts = list(importance.scan(texts, 2, 1000, piece))
        return [np.concatenate([p[2] for p in parts]).tolist(),
                sorted((p[0] + int(r), int(b)) for p in parts for r, b in zip(p[3], p[4]))]
    assert flat(16) == flat(200) == flat(1 << 20)
