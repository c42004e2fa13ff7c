"""URL filters beside plain Python."""

import re
from collections import defaultdict

import pytest

from panoloom.llm import urls

PAGES = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def walk(edges, seeds):
    total = sum(seeds.values())
    if not total:
        return {}
    start = {h: w / total for h, w in seeds.items()}
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(start)
    for _ in range(urls.ROUNDS):
        moved = defaultdict(float)
        for (a, b), w in edges.items():
            moved[b] += urls.DAMPING * score.get(a, 0) * w / out[a]
        rest = 1 - sum(moved.values())
        for h, w in start.items():
            moved[h] += rest * w
        score = moved
    return score


def brute(rows, rules=urls.RULES):
    split_rows = [(i, *split(u), html) for i, u, html in rows]
    edges = defaultdict(float)
    for _, host, _, html in split_rows:
        for u in re.findall(urls.HREF.removeprefix("(?i)"), html or "", re.I):
            edges[host, split(":" + u if u.startswith("//") else u)[0]] += 1
    for h in {h for _, h, _, _ in split_rows}:
        parts = h.split(".")
        for k in range(1, len(parts) - 1):
            edges[h, ".".join(parts[k:])] += urls.PARENT_WEIGHT
            edges[".".join(parts[k:]), h] += urls.PARENT_WEIGHT
    edges = {(a, b): w for (a, b), w in edges.items() if a and b and a != b}
    good, bad, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, h, p, _ in split_rows:
        r = rule_of(h, p, rules)
        n[h] += 1
        good[h] += bool(r and r[2])
        bad[h] += bool(r and not r[2])
    trust = walk(edges, {h: good[h] / n[h] for h in n if h and good[h]})
    distrust = walk({(b, a): w for (a, b), w in edges.items()}, {h: bad[h] / n[h] for h in n if h and bad[h]})
    out = []
    for i, h, p, _ in split_rows:
        r = rule_of(h, p, rules)
        fine = r[2] if r else distrust.get(h, 0) <= trust.get(h, 0) * (1 + 1e-9)
        out.append((i, h, p, r[0] + r[1] if r else None, "allow" if fine else "block"))
    return sorted(out, key=str)


def judged(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()), key=str)


LINKED = [
    (1, "https://Good.Example.ORG/a", '<a href="http://friend.net/x">f</a>'),
    (2, "http://friend.net/", '<A HREF=\'https://other.net\'>o</A> <img src=http://pic.net/i.png>'),
    (3, "http://bad.example.com/de/1", "<a href='http://good.example.org/'>g</a>"),
    (4, "http://farm.net/z?x=http://q", '<a href="http://bad.example.com/de/9">b</a><a href="/rel">r</a>'),
    (5, "http://other.net#f", None), (6, "http://pic.net", ""), (7, None, '<a href="http://x.net">'), (8, "no scheme", "x"),
    (9, "://", "y"), (10, "ftp://org", "z"), (11, "http://org/", ""), (12, "http://xexample.org/es/", ""),
    (13, "http://example.org/es", ""), (14, "http://www.example.org/en/17?q", ""), (14, "http://www.example.org/en/17?q", ""),
    (15, "http://ÀB.com/fr/x\ny", ""), (17, "https://mirror.net/", "<a href='//BAD.example.com/de/2'>x</a>"),
    (16, "http://a.com/FR/", "<p>" + "w " * 50_000),
]


def test_links_and_rules(spark):
    assert judged(spark.createDataFrame(LINKED, PAGES)) == brute(LINKED)
    by = {r[0]: r for r in brute(LINKED)}
    assert by[2][4] == "allow" and by[4][4] == by[17][4] == "block"      # linked from trust, linking to a blocked host


def test_other_columns_and_empty(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in LINKED], PAGES + ", host int, verdict string")
    assert judged(df) == brute(LINKED)
    assert judged(spark.createDataFrame([], PAGES)) == []


@pytest.mark.parametrize("name", ["op5_url_filters"])
def test_query(spark, small, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.QUERIES[name](spark, small).collect()), key=str)
    assert got == brute(rows)


def test_small_scores_decide(spark, monkeypatch):
    """Verdicts do not change where every score is 1e-15 of its value, as in a graph of many seeds and hops."""
    real = urls.propagate

    def small(*args):
        return real(*args).selectExpr("host", "score * 1e-15 as score")
    monkeypatch.setattr(urls, "propagate", small)
    assert judged(spark.createDataFrame(LINKED, PAGES)) == brute(LINKED)
