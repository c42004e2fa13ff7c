"""Window functions over long sequences without one task per sequence.

A plain ``Window.partitionBy(video)`` sends a whole video to one task. Here each sequence is cut into
segments; rows are windowed inside ``(key, segment)`` and a much smaller table with one row per
segment carries the running value across segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG = "__seg"


def spread(df: DataFrame, *keys) -> DataFrame:
    """Shuffle by ``keys`` into the configured number of partitions.

    For rows that unfold afterwards (planes to pixels): adaptive execution would size partitions by
    the folded bytes and leave too few of them, so the number is stated.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _local(keys, order):
    return Window.partitionBy(*keys, SEG).orderBy(*order)


def _before(keys):
    return Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], order: list, seg: Column,
                pos: str = "n", total: str | None = None, unfolds: bool = False) -> DataFrame:
    """0-based position of each row in its sequence, optionally with the sequence length."""
    df = df.withColumn(SEG, seg)
    carry = df.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("__n"))
    cols = [F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)).alias("__base")]
    if total:
        cols.append(F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    carry = carry.select(*keys, SEG, *cols)
    local = (spread(df, *keys, SEG) if unfolds else df).withColumn("__rn", F.row_number().over(_local(keys, order)))
    return (local.join(carry, keys + [SEG])
            .withColumn(pos, F.col("__base") + F.col("__rn") - 1)
            .drop(SEG, "__rn", "__base"))


def running_sums(df: DataFrame, keys: list[str], order: list, seg: Column,
                 sums: dict[str, Column], exclusive: bool = False) -> DataFrame:
    """Running BIGINT sums along each sequence; ``exclusive`` leaves out the current row."""
    df = df.withColumn(SEG, seg)
    last = -1 if exclusive else 0
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, last)
    carry = df.groupBy(*keys, SEG).agg(*[F.sum(e).alias(f"__t_{o}") for o, e in sums.items()])
    carry = carry.select(*keys, SEG, *[
        F.coalesce(F.sum(f"__t_{o}").over(_before(keys)), F.lit(0)).alias(f"__b_{o}") for o in sums])
    local = df.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(f"__l_{o}")
                             for o, e in sums.items()])
    out = local.join(carry, keys + [SEG])
    keep = [c for c in df.columns if c != SEG]
    return out.select(*keep, *[(F.col(f"__b_{o}") + F.col(f"__l_{o}")).cast("bigint").alias(o) for o in sums])


def previous(df: DataFrame, keys: list[str], order: list[str], seg: Column,
             cols: list[str], prefix: str = "prev_") -> DataFrame:
    """The given columns of the preceding row of the sequence (NULL on its first row)."""
    df = df.withColumn(SEG, seg)
    item = F.struct(*cols)
    carry = df.groupBy(*keys, SEG).agg(F.max_by(item, F.struct(*order)).alias("__last"))
    carry = carry.select(*keys, SEG, F.lag("__last").over(
        Window.partitionBy(*keys).orderBy(SEG)).alias("__carry"))
    local = df.withColumn("__lag", F.lag(item).over(_local(keys, order)))
    out = local.join(carry, keys + [SEG]).withColumn("__p", F.coalesce("__lag", "__carry"))
    return out.select(*[c for c in df.columns if c != SEG],
                      *[F.col(f"__p.{c}").alias(prefix + c) for c in cols])


def key_totals(df: DataFrame, keys: list[str], seg: Column, aggs: dict) -> DataFrame:
    """Attach whole-key values to every row, joined by ``(key, segment)`` so no key is hot.

    ``aggs`` maps an output name to ``(F.sum | F.min | F.max, expression)``.
    """
    df = df.withColumn(SEG, seg)
    parts = df.groupBy(*keys, SEG).agg(*[fn(e).alias(o) for o, (fn, e) in aggs.items()])
    w = Window.partitionBy(*keys)
    totals = parts.select(*keys, SEG, *[fn(o).over(w).alias(o) for o, (fn, _) in aggs.items()])
    return df.join(totals, keys + [SEG]).drop(SEG)


def latest_before(df: DataFrame, keys: list[str], order: list, seg: Column, value: str, out: str) -> DataFrame:
    """The last value that is not null in the rows before each row."""
    df = df.withColumn(SEG, seg)
    held = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    carry = df.groupBy(*keys, SEG).agg(held.alias("__v"))
    carry = carry.select(*keys, SEG, F.last("__v", ignorenulls=True).over(_before(keys)).alias("__carry"))
    here = F.last(value, ignorenulls=True).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return (df.withColumn("__here", here).join(carry, keys + [SEG])
            .withColumn(out, F.coalesce("__here", "__carry")).drop(SEG, "__here", "__carry"))
