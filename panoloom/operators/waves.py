"""Early stop as saved work: time is worked through in waves, and sequences that are done are not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.operators.segments import running_sums
from panoloom.session import stored

BUCKETS = 64


def write_waves(rows: DataFrame, path: str, keys: list[str], wave: Column, buckets: int = BUCKETS) -> None:
    """``rows`` in folders by ``wave`` and by a bucket of their key, so that either can be left out of a scan."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    (rows.withColumn("wave", wave.cast("int")).withColumn("bucket", bucket).repartition("wave", "bucket")
     .write.partitionBy("wave", "bucket").parquet(path))


def target_stop_waves(spark: SparkSession, path: str, starts: DataFrame, keys: list[str], order: list, seg: Column, done: Column,
                      per_block: int, target: Column, report: list | None = None) -> DataFrame:
    """The rows of ``sampling.target_stop`` over a table of ``write_waves``; ``target`` is a function of the key.

    A wave leaves out the files of buckets whose sequences are all done; of the rows read, those of other sequences that have reached their target go
    before any other work. The state is one row per sequence, and sequences are all known from the first wave on (``starts``). ``report`` takes (wave, rows
    read, rows worked on).
    """
    table = spark.read.parquet(path)
    waves = [r["wave"] for r in table.select("wave").distinct().orderBy("wave").collect()]        # folders, not rows
    state = stored(starts.select(*keys).distinct().withColumns({"blocks": F.lit(0).cast("bigint"), "over": F.lit(False)}), "state")
    shut: list[int] = []
    out = []
    for k in waves:
        read = table.where((F.col("wave") == k) & ~F.col("bucket").isin(shut))
        closed = state.where("over").select(*keys)
        part = stored(read.join(closed, keys, "left_anti"), "wave")
        if report is not None:
            report.append((k, read.count(), part.count()))
        before = running_sums(part, keys, order, seg, {"here": done.cast("bigint")}, exclusive=True)
        before = before.join(state.select(*keys, "blocks"), keys, "left").withColumn("blocks_before", F.coalesce("blocks", F.lit(0)) + F.col("here"))
        out.append(before.where((target <= 0) | (F.col("blocks_before") * per_block < target)).drop("here", "blocks"))
        gained = part.groupBy(*keys).agg(F.sum(done.cast("bigint")).alias("gained"))
        total = F.coalesce("blocks", F.lit(0)) + F.coalesce("gained", F.lit(0))
        state = state.join(gained, keys, "left").select(*keys, total.alias("blocks"), F.coalesce((target > 0) & (total * per_block >= target), F.lit(False)).alias("over"))
        state = stored(state, "state")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        per = state.groupBy(bucket.alias("bucket")).agg(F.bool_and("over").alias("all_over")).where("all_over").collect()
        shut = [r["bucket"] for r in per]
    rows = out[0] if out else table.withColumn("blocks_before", F.lit(0).cast("bigint"))
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.drop("wave", "bucket")
