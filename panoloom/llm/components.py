"""Connected components of an edge table, by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours, so stars form in a logarithmic number of rounds. No component
is gathered anywhere: a hub's edges are combined by partial minima before they are shuffled. The minima are written before
they are joined, so that either side of the join has a shuffle of its own and adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = c.stored(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
    return (both.where("b > a").join(low, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = c.stored(down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "low")
    moved = down.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "component", rounds: int = 60) -> DataFrame:
    """``node, <name>`` for every node of the long columns ``a, b``; the component is its smallest node.

    Each round is written to the shared folder. It ends when a round changes nothing.
    """
    edges = c.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def mark(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = c.stored(_small(_large(edges)), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    star = edges.select(F.col("a").alias("node"), F.col("b").alias(name))
    return star.union(edges.select(F.col("b").alias("node"), F.col("b").alias(name)).distinct())
