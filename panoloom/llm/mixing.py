"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are range-sorted by that key: the leading bits
name a key range, rows are summed inside their (source, range), and one row per (source, range) carries the sum of the
ranges before it. A source is cut where its budget ends; a budget beyond the source's size repeats whole epochs first.

Only DataFrame functions are used. No group is larger than one key range of one source, however large the source.

Defined cases: a null text has size 0; null sources form one source, sorted last; repeated rows are rows of their own;
a source without words has target 0; an empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Words are runs of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
RANGE_ROWS = 2_000     # documents a key range holds on average; sets memory per task, never the result


def sized(docs: DataFrame, seed: str = "mix", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """``doc_id, source, size, key`` of every document; the key is a 60-bit number from a digest of seed and id.

    ``keep`` names a column to hold the whole row.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        *([F.struct(*docs.columns).alias(keep)] if keep else []))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target``, one row per source.

    Sources in code-point order (null last) weigh ``weights``, repeating. ``share`` of all words is split by weight; a
    source above ``cap`` times its size stops there and the excess is split again. The fixed point is one water level:
    sources are filled in order of cap per weight, and the level is that of the first source which its cap leaves alone.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    per = per.withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = ((F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), zero))
             / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), zero)))
    per = per.withColumn("__level", level).withColumn("__at", F.row_number().over(order))
    free = F.when(F.col("__cap") / F.col("__w") >= F.col("__level"), F.col("__at"))
    per = per.withColumn("__final", F.min_by("__level", free).over(whole))
    return per.select("source", "source_size",
                      F.least(F.col("__cap"), F.coalesce(F.col("__final") * F.col("__w"), F.col("__cap"))).alias("target"))


def mix(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, ranges: int = 1, wide: DataFrame | None = None) -> DataFrame:
    """Rows of ``sized`` with ``source_size, target, taken``: how many of its words the mix takes, repeats counted.

    The document in which a source's budget ends is taken in part, so that each source gives its rounded target exactly.
    ``wide`` has the same rows with more columns, which the result then keeps; sums and targets come from the narrow ones.
    """
    bits = max(0, math.ceil(math.log2(max(1, ranges))))
    number = F.shiftright("key", KEY_BITS - bits) if bits else F.lit(0).cast("long")
    sizes = sizes.withColumn("__range", number)
    rows = sizes if wide is None else wide.withColumn("__range", number)
    within = (Window.partitionBy("source", "__range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__here", F.coalesce(F.sum("size").over(within), F.lit(0)))
    carry = sizes.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(F.col("source").alias("__s"), F.col("__range").alias("__r"),
                         F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    goal = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "__t")
    carry = carry.join(goal, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    rows = rows.join(carry, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(budget / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__base") - F.col("__here")))
    return rows.withColumn("taken", epochs * F.col("size") + last).drop("__s", "__r", "__range", "__here", "__base")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` over whole texts; texts are read once and only sizes are kept and shuffled."""
    sizes = c.stored(sized(docs), "sizes")
    return mix(sizes, ranges=-(-sizes.count() // RANGE_ROWS), **options)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs`` with ``size, source_size, target, taken``; these replace columns of such names.

    Texts go through the shuffle by key range once, so repeated rows, which no join could tell apart, keep their own shares.
    """
    sizes = c.stored(sized(docs), "sizes")
    rows = mix(sizes, ranges=-(-sizes.count() // RANGE_ROWS), wide=sized(docs, keep="__row"), **options)
    new = ("size", "source_size", "target", "taken")
    return rows.select(*[F.col("__row").getField(n).alias(n) for n in docs.columns if n not in new], *new)


def op8_mixing(spark, sf_dir):
    """All documents mixed to weights 5, 2, 1 and 150 % of all words."""
    return mix_documents(c.read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def sql(docs: str = "documents") -> str:
    return rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                  cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as key
           from {docs}),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as w,
             2.0::double * source_size as cap from s),
l as (select *, row_number() over o as pos,
             (1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
      from w window o as (order by cap / w, source nulls last),
                    b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select min_by(level, pos) as level from l where cap / w >= level),
t as (select source, source_size, least(cap, coalesce(f.level * w, cap)) as target from l cross join f),
r as (select d.*, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as budget,
             coalesce(sum(size) over (partition by d.source order by key, doc_id nulls first, size
                                      rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source),
e as (select *, coalesce(budget // nullif(source_size, 0), 0) as epochs from r)
select doc_id, size, source_size, target,
       cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) as bigint) as taken from e"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLE = {"op8_mixing": sql()}
