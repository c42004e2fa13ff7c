"""Vector codes beside a comparison of every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from panoloom.llm import codes

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds, scale=1024):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1])
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=key)
    dim = len(kept[0][1]) if kept else 0
    if not dim or dim % parts:
        return []
    kept = [r for r in kept if len(r[1]) == dim]
    size = dim // parts

    def whole(x):
        return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale
    vectors = [[[whole(x) for x in r[1][p * size:(p + 1) * size]] for p in range(parts)] for r in kept]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def find(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            went = {}
            for v in vectors:
                went.setdefault(find(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(t) // len(went[e]) for t in zip(*went[e])] if e in went else y for e, y in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(t) for b in books for y in b for t in y).encode()).hexdigest()
    out, per = [], {}
    for r, v in zip(kept, vectors):
        found = [find(x, b) for x, b in zip(v, books)]
        error = sum(d for d, _ in found)
        per[r[2]] = per.get(r[2], 0) + min(error, codes.LARGEST)
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), min(error, codes.LARGEST), r[2]))
    return sorted(((i, k, e, min(per[lab], codes.LARGEST), digest) for i, k, e, lab in out), key=str)


def result(df, **options):
    cols = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in codes.compress(df, **options).select(*cols).collect()), key=str)


def make(seed, n, dim, grid):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-grid, grid) / 64 for _ in range(dim)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "entries", "grid"), [(150, 8, 16, 4), (90, 12, 30, 2000), (40, 4, 256, 1)])
def test_small_grids_with_many_ties(spark, n, dim, entries, grid):
    rows = make(n, n, dim, grid)
    assert result(spark.createDataFrame(rows, SHAPE), entries=entries) == brute(rows, 4, entries, 4)


def test_corner_cases(spark):
    rows = make(5, 30, 8, 50)
    rows += [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("inf")] * 8, 0), (104, [0.5] * 4, 0), (105, [], 0),
             (None, [0.25] * 8, None), (None, [0.25] * 8, None), (7, [-0.3] * 8, 2), (7, [-0.3] * 8, 2), (8, [1e30] * 8, 3), (9, [-1e308, 1e308] * 4, 3), (10, [5e5] * 8, 3)]
    assert result(spark.createDataFrame(rows, SHAPE), entries=8) == brute(rows, 4, 8, 4)
    assert result(spark.createDataFrame([], SHAPE)) == []
    assert result(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SHAPE)) == []
    assert result(spark.createDataFrame([(1, None, 1)], SHAPE)) == []


def test_clashing_columns(spark):
    rows = make(6, 20, 8, 50)
    df = spark.createDataFrame([(*r, "x", 3, [9]) for r in rows], SHAPE + ", code string, error int, vector array<int>")
    assert result(df, entries=4) == brute(rows, 4, 4, 4)
    found = codes.encode(df, codes.train(df, entries=4), names=("my_code", "my_error"))
    assert found.columns == ["vec_id", "label", "code", "error", "vector", "my_code", "my_error"] and found.where("code = 'x'").count() == 20


@pytest.mark.parametrize("dim", [1, 16, 300])
def test_search_equals_full_comparison(dim):
    rng = np.random.default_rng(dim)
    x, book = rng.integers(-9000, 9000, (400, dim)), rng.integers(-9000, 9000, (256, dim))
    book[100:120] = book[3]
    x[:30] = book[rng.integers(0, 256, 30)]
    d = ((x[:, None, :] - book[None]) ** 2).sum(-1)
    which, best = codes.nearest(x, book)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
