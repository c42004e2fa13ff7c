"""Removal of repeats beside a count of every window."""

import hashlib
import random
from collections import Counter

import pytest

from panoloom.llm import dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in dedup.remove_repeats(df, **options).select(*cols).collect()), key=str)


def test_real_documents(documents, real):
    assert result(documents(real)) == brute(real, dedup.LENGTH)


def pasted(seed, n=60, alphabet="abcdé \n"):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [make(rng.randrange(10, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(x for _ in range(rng.randrange(5)) for x in (make(rng.randrange(30)), rng.choice(shared)))
        rows.append((i, t if rng.random() > 0.1 else t + t))
    return rows


@pytest.mark.parametrize(("length", "gram", "group"), [(24, 8, 1024), (24, 8, 2), (40, 20, 3), (33, 5, 4)])
def test_short_windows_and_divided_anchors(documents, length, gram, group):
    rows = pasted(length + group)
    assert result(documents(rows), length=length, gram=gram, group=group) == brute(rows, length)


def test_pieces_of_long_texts(documents):
    rows = pasted(77)
    rows += [(100, "".join(t for _, t in rows[:30])), (101, "ab" * 500 + rows[7][1] + "ab" * 300)]
    assert result(documents(rows), length=24, gram=8, piece=100) == brute(rows, 24)


def test_corner_cases(documents):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 450), (5, "ab" * 1000), (6, long), (7, long[100:500] + "tail"), (8, "é" * 100), (8, "é" * 100),
            (9, long[:199]), (10, "unique " + "".join(chr(200 + i % 97) for i in range(300))), (11, long[5000:5200]), (12, "x" * 200), (13, "y" * 200)]
    df = documents(rows).withColumnRenamed("lang", "h").withColumnRenamed("source", "ranges")
    assert result(df) == brute(rows, dedup.LENGTH)
    assert result(documents([])) == []


def test_kept_text(documents):
    rows = [(1, "a" * 100 + "0123456789" * 3), (2, "0123456789" * 3 + "b")]
    got = {r.doc_id: r for r in dedup.remove_repeats(documents(rows), length=20, gram=6, keep_text=True).collect()}
    for i, t in rows:
        b, left = t.encode(), []
        at = 0
        for s, e in got[i].removed:
            left.append(b[at:s])
            at = e
        assert bytes(got[i].kept) == b"".join(left) + b[at:] and got[i].n_removed == len(b) - len(got[i].kept)
