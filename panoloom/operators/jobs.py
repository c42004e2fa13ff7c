"""Manifest-level operators: choosing variants and outputs, ledgers and job totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoloom.settings import VIDEO_FILE

TRANSLUCENT, OPAQUE = "TRANSLUCENT", "OPAQUE"


def variant_tier(codec: Column, height: Column, vid: Column) -> Column:
    """Preference ladder, 1 is best."""
    return (F.when(F.startswith(codec, F.lit("avc")) & (height <= 1080), 1)
            .when(height <= 1080, 2)
            .when(vid == "22", 3).when(vid == "18", 4).otherwise(5))


def best_variant(df: DataFrame, key: str, tie: str) -> DataFrame:
    """One variant per key; a plain aggregation, so a key with many variants combines before the shuffle."""
    rank = F.struct(variant_tier(F.col("codec"), F.col("height"), F.col("id")).alias("tier"),
                    (-F.col("height")).alias("lower"), "id", tie, "codec", "height")
    return (df.groupBy(key).agg(F.min(rank).alias("r"))
            .select(key, "r.id", "r.codec", "r.height", "r.tier", f"r.{tie}"))


def pick_output(df: DataFrame, folder: str, name: str) -> DataFrame:
    """First finished video file of each folder, or ``missing``."""
    hit = F.when(F.col(name).rlike(VIDEO_FILE), F.col(name))
    return (df.groupBy(folder).agg(F.min(hit).alias("output"))
            .withColumn("status", F.when(F.col("output").isNull(), "missing").otherwise("ok")))


def pending(manifest: DataFrame, ledger: DataFrame, key: str = "url") -> DataFrame:
    """Manifest rows with no earlier result."""
    return manifest.join(ledger.select(key).distinct(), key, "left_anti")


def job_status(error: Column, n_chunks: Column) -> Column:
    return (F.when(error.isNotNull(), "failed")
            .when(F.coalesce(n_chunks, F.lit(0)) == 0, "empty").otherwise("ok"))


def job_summary(manifest: DataFrame, results: DataFrame, key: str = "url") -> DataFrame:
    """Items per status; manifest items without a result row count as empty.

    Repeated URLs are counted before the join, so one URL with many copies is one row of it; several results of one URL
    are one, failed if any failed.
    """
    results = results.groupBy(key).agg(F.min("error").alias("error"), F.sum("n_chunks").alias("n_chunks"))
    asked = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    joined = asked.join(results, key, "left")
    return (joined.withColumn("status", job_status(F.col("error"), F.col("n_chunks")))
            .groupBy("status").agg(F.sum("copies").alias("n_items"),
                                   F.coalesce(F.sum(F.col("copies") * F.col("n_chunks")), F.lit(0)).cast("bigint").alias("n_chunks")))


def sheet_mode(mode: Column) -> Column:
    """Mode of a job, spaces and case ignored; anything unset is translucent, any other word gives null."""
    word = F.coalesce(F.upper(F.trim(mode)), F.lit(TRANSLUCENT))
    return F.when(word == "", TRANSLUCENT).when(word.isin(TRANSLUCENT, OPAQUE), word)
