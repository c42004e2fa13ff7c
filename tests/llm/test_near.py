"""N-gram Jaccard join beside comparison of all pairs."""

import random

import numpy as np
import pytest

from panoloom.llm import near


def shingle_set(text, n=5):
    w = [x for x in "".join(ch if ord(ch) > 32 else " " for ch in (text or "").lower()).split(" ") if x]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{row number: (class, links, group)}."""
    sets = [shingle_set(t) for _, t in rows]
    first, ids = {}, [d for d, _ in rows]
    for i, s in enumerate(sets):
        first[s] = min(first.get(s, ids[i]), ids[i])
    kinds = list(first)
    linked = {s: set() for s in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                linked[a].add(b)
                linked[b].add(a)
    group = {}
    for s in kinds:
        seen, todo = {s}, [s]
        while todo:
            for t in linked[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        group[s] = min(first[t] for t in seen)
    return sorted((ids[i], first[s], len(linked[s]), group[s]) for i, s in enumerate(sets))


def result(df):
    return sorted((r.doc_id, r.class_id, r.n_links, r.group_id) for r in near.near_duplicates(df).collect())


def copies(n, words=120, edits=3, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        t = base[:]
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append((1000 + k, " ".join(t)))
    return out


def test_real_documents(documents, real):
    assert result(documents(real)) == brute(real)


def test_one_large_group_and_blocks(documents, monkeypatch):
    monkeypatch.setattr(near, "SIGNATURE_BLOCK", 7)
    monkeypatch.setattr(near, "SET_BLOCK", 5)
    rows = copies(60) + copies(20, seed=2, edits=6)
    assert result(documents(rows)) == brute(rows)


def test_corner_cases(documents):
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "two words"), (5, "Two  words"), (6, "a b c d e"), (6, "a b c d e"),
            (7, "x" * 50_000), (8, "y " * 30_000), (9, "y " * 30_001)]
    assert result(documents(rows)) == brute(rows)
    kept = near.one_of_each(documents(rows).withColumnRenamed("lang", "group_id"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]
    assert kept.columns == ["doc_id", "text", "group_id", "source", "n_chars"]


def test_null_and_repeated_ids(documents):
    rows = [(None, "one two three four five six"), (None, "other words stand in this text"), (-1, "a third text of some words"),
            (7, "first text of this number here"), (7, "second text with that number too"), (None, "first text of this number here")]
    got = near.near_duplicates(documents(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.class_key, []).append((r.doc_id, r.class_id, r.group_id, r.n_copies))
    assert sorted(by.values(), key=str) == sorted([[(None, None, None, 1)], [(None, None, None, 1)], [(-1, -1, -1, 1)], [(7, 7, 7, 1)],
                                                   by[next(k for k, v in by.items() if len(v) == 2)]], key=str)
    assert sorted(next(v for v in by.values() if len(v) == 2), key=str) == [(7, 7, 7, 2), (None, 7, 7, 2)]
    assert len({r.group_key for r in got}) == 5 and sum(r.is_first for r in got) == 5
    assert near.one_of_each(documents(rows)).count() == 5


def test_empty(documents):
    assert near.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pruning_keeps_what_can_reach_the_threshold(threshold):
    rng = np.random.default_rng(0)
    least = near.least_matches(threshold)
    lost = 0
    for _ in range(3000):
        hits = np.cumsum(rng.random(near.HASHES) < threshold)[near.STEP - 1::near.STEP]
        lost += any(h < m for h, m in zip(hits, least))
    assert lost <= 3
