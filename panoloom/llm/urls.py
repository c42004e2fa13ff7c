"""URL filters: explicit rules first, then trust that spreads over links.

Hosts are the nodes of a graph; a page's host links to the hosts of the absolute links in its HTML and, weakly, to its parent
domains. Personalised PageRank from trusted seeds over the edges gives trust; the same walk over reversed edges from blocked
seeds gives distrust, since who links to blocked hosts resembles them. A host is blocked when its distrust is larger
than ``ratio`` times its trust; a host that neither reaches is allowed.

Links are aggregated to (host, host) weights before anything is joined, so pages of one host never meet in a task. Each
round is one join on the edges' source, whose transitions are pre-aggregated, and is written to the shared folder.

Defined cases: a null URL, or one without ``://``, has empty host and path; such a page fits no rule and is allowed; pages
without HTML have no links; self links do not count; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: (host, path start, allow) of the production rules.
RULES = (("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False),
         ("com", "/fr/", True), ("com", "/de/", False))
ROUNDS, DAMPING, RATIO = 8, 0.85, 1.0
SLACK = 1e-9            # relative; sums differ in their last digits
PARENT_WEIGHT = 0.25
#: Targets of links that name a host, with a scheme or by ``//`` alone: everything up to the end of the attribute.
HREF = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, bool]) -> Column:
    h, p, _ = rule
    return ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, allow) of the longest fitting rule, both null without one; of equally long rules the first in order."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("boolean")
    name = F.coalesce(*[F.when(fits(host, path, r), F.lit(r[0] + r[1])) for r in ordered])
    allow = F.coalesce(*[F.when(fits(host, path, r), F.lit(r[2])) for r in ordered])
    return name, allow


def parents(host: Column) -> Column:
    """Domains above a host that still have a dot."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(parts, i + 1, n - i), "."))
                  ).otherwise(F.array().cast("array<string>"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, w``: links between different hosts, and weak edges both ways between a host and its parent domains."""
    host = host_of(F.col(url_col))
    linked = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(HREF), F.lit(1))).alias("u"))
    target = F.when(F.startswith("u", F.lit("//")), F.concat(F.lit(":"), F.col("u"))).otherwise(F.col("u"))     # the page's own scheme
    linked = linked.select("src", host_of(target).alias("dst"), F.lit(1.0).alias("w"))
    hosts = pages.select(host.alias("h")).distinct()
    up = hosts.select(F.col("h").alias("src"), F.explode(parents(F.col("h"))).alias("dst"), F.lit(PARENT_WEIGHT).alias("w"))
    both = linked.union(up).union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return (both.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
            .groupBy("src", "dst").agg(F.sum("w").alias("w")))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host, score`` of the personalised PageRank from ``seeds`` (host, weight), after a fixed number of rounds.

    Seeds share one unit of restart weight; what hosts without out-links hold restarts as well.
    """
    out = edges.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("total"))
    steps = c.stored(edges.join(out, F.col("src") == F.col("s")).select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "steps")
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    start = c.stored(seeds.groupBy("host").agg((F.sum("weight") / F.lit(float(total))).alias("start")), "seeds")
    score = start.select("host", F.col("start").alias("score"))
    for _ in range(rounds):
        moved = steps.join(score, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        moved = c.stored(moved.groupBy("host").agg(F.sum("score").alias("score")), "walk")
        kept = moved.agg(F.sum("score")).first()[0] or 0.0
        score = moved.unionByName(start.select("host", (F.col("start") * (1.0 - kept)).alias("score")))
        score = c.stored(score.groupBy("host").agg(F.sum("score").alias("score")), "walk")
    return score


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    Hosts are seeded by the rules' verdicts on their own pages: the allowed share of a host's pages is trusted, the blocked share is not.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, allow = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("allow", allow)
    known = c.stored(rows.groupBy("host").agg(
        F.count(F.when(F.col("allow"), 1)).alias("good"), F.count(F.when(~F.col("allow"), 1)).alias("bad"), F.count(F.lit(1)).alias("n")), "hosts")
    edges = c.stored(host_edges(pages), "host-edges")
    seeds = known.where("host <> ''")
    trust = propagate(edges, seeds.where("good > 0").select("host", (F.col("good") / F.col("n")).alias("weight")), rounds, damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, seeds.where("bad > 0").select("host", (F.col("bad") / F.col("n")).alias("weight")), rounds, damping)
    per = (known.select("host").join(trust.select("host", F.col("score").alias("trust")), "host", "left")
           .join(distrust.select("host", F.col("score").alias("distrust")), "host", "left")
           .select(F.col("host").alias("__h"), *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("trust", "distrust")]))
    out = rows.join(per, F.col("host") == F.col("__h"))         # scores are shares of one unit over all hosts, so small ones count: no rounding
    fine = F.coalesce(F.col("allow"), F.col("distrust") <= ratio * F.col("trust") * (1 + SLACK))
    return out.select("page_id", "host", "path", "rule", F.when(fine, "allow").otherwise("block").alias("verdict"), "trust", "distrust")


def op5_url_filters(spark, sf_dir):
    """Rules and propagated trust for all pages."""
    return judge(c.read(spark, sf_dir, "pages"))


QUERIES = {"op5_url_filters": op5_url_filters}
