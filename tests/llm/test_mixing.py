"""Mixing beside water-filling and cutting in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panoloom.llm import mixing


def targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def brute(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows]
    per = {}
    for (_, _, s), n in zip(rows, size):
        per[s] = per.get(s, 0) + n
    goal = targets(per, weights, share, cap)
    key = lambda k: (int(hashlib.md5(f"mix:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:15], 16),
                     rows[k][0] is not None, rows[k][0] or 0, size[k])
    before, out = dict.fromkeys(per, 0), []
    for k in sorted(range(len(rows)), key=key):
        s = rows[k][2]
        budget = int(goal[s] + 0.5)
        full = budget // per[s] if per[s] else 0
        part = max(0, min(size[k], budget - full * per[s] - before[s]))
        before[s] += size[k]
        out.append((rows[k][0], size[k], per[s], round(goal[s], 6), full * size[k] + part))
    return sorted(out, key=str)


def mixed(df, **options):
    got = mixing.mix(mixing.sized(df), **options).select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=str)


CASES = [(i, "w " * (i * 7 % 23), ["a", "b", "é", None, "hot"][min(i % 9, 4)]) for i in range(120)]


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_ranges_do_not_matter(documents, ranges):
    assert mixed(documents(CASES), ranges=ranges) == brute(CASES)


@pytest.mark.parametrize(("weights", "share", "cap"), [((1,), 1.0, 1.0), ((5, 2, 1), 0.3, 2.0), ((9, 1), 1.9, 2.0), ((1, 100), 0.5, 0.6)])
def test_other_targets(documents, weights, share, cap):
    assert mixed(documents(CASES), weights=weights, share=share, cap=cap) == brute(CASES, weights, share, cap)


def test_budgets_are_met(documents):
    rows = mixing.mix(mixing.sized(documents(CASES)), ranges=8).groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.g) <= 0.5 and r.over <= 0 for r in rows)


def test_corner_cases(documents):
    rows = [(1, None, None), (1, None, None), (2, "", "x"), (3, "a b c d\x0be", "y"), (3, "a b c d\x0be", "y"), (None, "w " * 50_000, "y")]
    df = documents(rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "key")
    assert mixed(df) == brute(rows)
    assert mixed(documents([])) == []
    assert mixed(documents([(1, "", "x"), (2, None, None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
