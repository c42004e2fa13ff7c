"""Quotation linking beside its SQL on conversations with quotes, and on a hand-made case."""

import random

import duckdb
import pytest

from panoloom.llm import quotes

COLUMNS = "conv_id long, turn long, role string, text string"
ORDER = ["conv_id", "turn", "role", "text", "reply_to", "linked", "n_quoted", "max_level", "branch", "position"]


def got(df):
    return sorted((tuple(r) for r in quotes.conversations(df).select(*ORDER).collect()), key=str)


def want(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return sorted(con.execute(f"select {', '.join(ORDER)} from ({quotes.sql()})").fetchall(), key=str)


def mail(seed, turns=40, convs=4):
    rng = random.Random(seed)
    rows, told = [], {}
    for conv in range(convs):
        said = []
        for turn in range(turns):
            parts = []
            for _ in range(rng.randrange(3)):
                if said:
                    level = rng.randrange(1, 4)
                    line = rng.choice(said)
                    parts += [("> " * level if rng.random() < .5 else ">" * level) + x for x in line.split("\n")]
            own = [f"Line {rng.randrange(30)} Of {rng.randrange(9)}" for _ in range(rng.randrange(3))]
            if own:
                said.append("\n".join(own))
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join(parts + ([""] if rng.random() < .5 else []) + own)))
    return rows


@pytest.mark.parametrize("stretch", [3, 256])
def test_mail(spark, stretch, monkeypatch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    rows = mail(1)
    assert got(spark.createDataFrame(rows, COLUMNS)) == want(rows)


def test_nested_reply(spark):
    rows = [(1, 0, "user", "How  are you?\nFine day."), (1, 1, "assistant", "> how are you?\nWell."), (1, 2, "user", "other"),
            (1, 3, "assistant", ">> How are you?\n> Well.\nGood.\n> nobody said this"), (1, 4, "user", "more")]
    out = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert [out[t].reply_to for t in range(5)] == [None, 0, 1, 1, 3]
    assert [out[t].linked for t in range(5)] == [False, True, False, True, False]
    assert out[3].text == "Good." and out[3].max_level == 2 and out[3].n_quoted == 3
    assert [out[t].branch for t in range(5)] == [0, 0, 0, 3, 3]
    assert [out[t].position for t in range(5)] == [1, 2, 3, 4, 5]


def test_thread_order(spark):
    """Answers follow what they answer with all that answers them, in turn order: 0 (1 (2, 4), 3 (5), 6 (7))."""
    rows = [(1, 0, "u", "zero"), (1, 1, "u", "one"), (1, 2, "u", "two"), (1, 3, "u", "> zero\nthree"), (1, 4, "u", "> one\nfour"),
            (1, 5, "u", "> three\nfive"), (1, 6, "u", "> zero\nsix"), (1, 7, "u", "seven")]
    out = sorted(quotes.conversations(spark.createDataFrame(rows, COLUMNS)).collect(), key=lambda r: r.position)
    assert [r.turn for r in out] == [0, 1, 2, 4, 3, 5, 6, 7] and [r.position for r in out] == list(range(1, 9))


@pytest.mark.parametrize("shape", ["star", "path"])
def test_rounds_are_the_logarithm_of_the_openings(spark, shape):
    n = 60
    turns = spark.createDataFrame([("k", t, t - t % 2) for t in range(2 * n)], "key string, turn long, branch long")
    runs = spark.createDataFrame([("k", 2 * b, None if b == 0 else 0 if shape == "star" else 2 * b - 2, 2) for b in range(n)],
                                 "key string, branch long, attach long, size long")
    found, rounds = quotes.starts(runs, turns)
    assert rounds <= (2 * n).bit_length() + 1
    got = {r.branch: r.start for r in found.collect()}
    assert got == {2 * b: 2 * b for b in range(n)}


def test_given_conversations_with_quotes(spark, small):
    df = quotes.quoted_threads(spark, small)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    rows = con.execute(f"select {', '.join(ORDER)} from ({quotes.ORACLE['quoted_threads']})").fetchall()
    assert sorted((tuple(r) for r in df.select(*ORDER).collect()), key=str) == sorted(rows, key=str)
    assert sum(r[5] for r in rows) > len(rows) / 4 and any(r[8] != rows[0][8] for r in rows)


def test_corner_cases(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "user", ""), (None, 0, "a", "x"), (None, 1, "b", ">x"), (2, None, "u", "y"), (2, 5, "u", "> y"),
            (2, 5, "u", "> y"), (3, 0, "u", ">"), (3, 1, "u", "long " * 40_000), (3, 2, "u", "> " + "long " * 40_000), (3, 3, "u", "a > b")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(df) == want(rows)
    assert got(df.selectExpr("*", "1 as position", "'x' as target", "2 as stretch")) == want(rows)
    assert got(spark.createDataFrame([], COLUMNS)) == []
