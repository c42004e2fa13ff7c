"""Fingerprints beside plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panoloom.llm import fingerprint as fp


def expected(rows):
    """{(doc_id, text): (n_chars, sha256 of the edited text, edited text, next text)} for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 2
        e = t[:len(t) - m] + nxt[:m]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), e, nxt)
    return out


def pieces(text):
    return re.findall(fp.PIECES, text, re.A)


def dice(a, b):
    a, b = set(pieces(a)), set(pieces(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def check(df, rows):
    want = expected(rows)
    next_text = fp.with_next(df, 3)
    got = {r.doc_id: r for r in next_text.collect()}
    assert {i: r.next_text for i, r in got.items()} == {i: w[3] for i, w in want.items()}
    return want


@pytest.mark.parametrize("size", [3, 2_000])
def test_query_on_real_rows(spark, small, real, size, monkeypatch):
    monkeypatch.setattr(fp.with_next, "__defaults__", (size,))
    want = expected(real)
    rows = fp.op2_fingerprints(spark, small).collect()
    assert len(rows) == len(want)
    text = dict(real)
    for r in rows:
        n, sha, edited, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(dice(text[r.doc_id] or "", edited))
        assert r.near_next == pytest.approx(dice(text[r.doc_id] or "", nxt))


def test_pieces_add_up(documents, real):
    df = documents(real).select("text", F.array_join(F.regexp_extract_all(F.col("text"), F.lit(fp.PIECES), F.lit(0)), "").alias("joined"))
    assert all(r.joined == (r.text or "") for r in df.collect())


def test_corner_cases(documents):
    rows = [(1, None), (2, ""), (4, "x" * 100_000), (9, "a b c."), (50_000, "é" * 3 + "\n\n b. c\nd"), (50_001, "tail")]
    check(documents(rows), rows)
    got = fp.fingerprints(documents(rows + [(7, "a b c.")])).select("doc_id", "tree.*").collect()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[7].fingerprint == by[9].fingerprint
    assert len({r.fingerprint for r in got}) == 5
    assert fp.with_next(documents([])).count() == 0
    assert [tuple(r) for r in fp.with_next(documents([(5, "only")])).collect()] == [(5, "only", "only")]


def test_repeated_and_null_numbers(documents):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "n"), (3, "c")]
    got = sorted(((r.doc_id, r.text, r.next_text) for r in fp.with_next(documents(rows), 1).collect()), key=str)
    assert len(got) == 5
    assert (3, "c") in [x[:2] for x in got] and (None, "n", "c") in got


def test_edits_are_located(documents):
    lines = [f"line {i} has words." for i in range(40)]
    other = lines[:]
    other[17] = "line 17 was changed."
    df = documents([(1, "\n".join(lines))]).withColumn("b", F.lit("\n".join(other)))
    r = df.select(fp.tree(F.col("text")).alias("a"), fp.tree(F.col("b")).alias("b")).select(
        fp.edited_paragraphs(F.col("a"), F.col("b")).alias("at"), fp.edited_paragraphs(F.col("a"), F.col("a")).alias("same"),
        "a.root", F.col("b.root").alias("other")).first()
    assert r["at"] == [17] and r["same"] == [] and r["root"] != r["other"]


def largest_range(df, rows):
    d = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h")
    sizes = [r["count"] for r in d.groupBy(fp.id_ranges(d, rows).alias("b")).count().collect()]
    assert sum(sizes) == df.count()
    return max(sizes)


def test_ranges_follow_rows_not_ids(documents, spark):
    far = [(i, f"t{i}") for i in range(6000)] + [(10 ** 15, "far")]
    assert largest_range(documents(far), 100) <= 200
    assert largest_range(documents([(7, f"t{i}") for i in range(3000)] + [(i * i, "x") for i in range(3000)]), 100) <= 200
    assert largest_range(documents([(None, f"t{i}") for i in range(3000)] + [(5, "x")]), 100) <= 200


@pytest.mark.parametrize("size", [1, 2, 2_000])
def test_ends_of_the_range_of_numbers(documents, size):
    rows = [(-9_223_372_036_854_775_807, "a b"), (9_223_372_036_854_775_807, "c d e"), (0, "m"), (9 * 10 ** 18, "n"), (-9 * 10 ** 18, "o p")]
    df = documents(rows)
    want = expected(rows)
    assert {r.doc_id: r.next_text for r in fp.with_next(df, size).collect()} == {i: w[3] for i, w in want.items()}
