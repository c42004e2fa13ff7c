"""Removal of repeated word runs beside a count of every window."""

import hashlib
import random
from collections import Counter

import pytest

from panoloom.llm import debruijn

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


def brute(rows, length):
    texts = [(i, split(t)) for i, t in rows]
    seen = Counter(tuple(w[p:p + length]) for _, w in texts for p in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                gone[p:p + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in debruijn.remove_repeats(df, **options).select(*cols).collect()), key=str)


def test_real_documents(documents, real):
    assert result(documents(real)) == brute(real, debruijn.LENGTH)


def pasted(seed, n=50, alphabet=6):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(alphabet)}" for _ in range(k)]
    shared = [make(rng.randrange(6, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = [x for _ in range(rng.randrange(5)) for x in make(rng.randrange(12)) + rng.choice(shared)]
        rows.append((i, "".join(x + rng.choice(SPACES) for x in w)))
    return rows


@pytest.mark.parametrize(("length", "gram", "alphabet"), [(7, 2, 40), (9, 3, 2), (12, 8, 300), (5, 5, 3)])
def test_short_windows(documents, length, gram, alphabet):
    rows = pasted(length * gram, alphabet=alphabet)
    assert result(documents(rows), length=length, gram=gram) == brute(rows, length)


def test_corner_cases(documents):
    long = " ".join(f"x{(i * i + i // 7) % 5003}" for i in range(20_000))
    ring = " ".join(["a b c"] * 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (None, "p q " * 30), (None, "p q " * 30), (6, long), (6, long), (7, "head " + long[:9000]),
            (8, ring), (9, "x\x00y \x1f \x85   " * 40), (10, " ".join(f"u{i}" for i in range(34))), (11, " ".join(f"u{i}" for i in range(34))),
            (12, " ".join(f"v{i}" for i in range(35))), (13, "\n".join(f"v{i}" for i in range(35)))]
    assert result(documents(rows)) == brute(rows, debruijn.LENGTH)
    assert result(documents([])) == []


def test_clashing_columns(spark):
    rows = [(1, "a b " * 40, 5, "x"), (2, "c d", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept_sha256 string")
    assert result(df) == brute([r[:2] for r in rows], debruijn.LENGTH)


def test_kept_words_and_ranges(documents):
    shared = [f"s{i}" for i in range(40)]
    a, b = ["alpha", *shared, "omega"], [*shared, "end"]
    rows = {r["doc_id"]: r for r in debruijn.remove_repeats(documents([(1, " ".join(a)), (2, " ".join(b))]), keep_text=True).collect()}
    assert bytes(rows[1]["kept"]) == b"alpha omega" and [tuple(x) for x in rows[1]["removed"]] == [(1, 41)]
    assert bytes(rows[2]["kept"]) == b"end" and [tuple(x) for x in rows[2]["removed"]] == [(0, 40)]


def test_paths_are_whole_repeated_passages(documents):
    """A passage that repeats as a whole is one path, however many anchors it has; a branch ends paths."""
    rng = random.Random(3)
    p, q = ([f"{k}{rng.randrange(10**6)}" for _ in range(300)] for k in "pq")
    rows = [(i, " ".join([f"own{i}{j}" for j in range(50)] + p + [f"tail{i}{j}" for j in range(9)])) for i in range(3)]
    rows += [(i, " ".join(q + [f"more{i}"])) for i in (7, 8)]
    found = sorted((r["n_documents"], r["n_spans"], r["longest"]) for r in debruijn.passages(documents(rows)).collect())
    assert found == [(2, 2, 300), (3, 3, 300)]
    rows = [(1, " ".join(p)), (2, " ".join(p)), (3, " ".join(p[:150] + q)), (4, " ".join(p[:150] + q))]
    spans = [tuple(r) for r in debruijn.passages(documents(rows)).select("n_documents", "longest").collect()]
    assert sorted(spans)[-1] == (4, 150) and len(spans) == 3
