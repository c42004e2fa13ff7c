"""The events table seen as one ordered signal per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.operators.segments import number_rows
from panoloom.settings import DAY_US

KEY = ["user_id"]
ORDER = ["us", "event_id"]


def day():
    return F.expr(f"us div {DAY_US}")


def events(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return (spark.read.parquet(f"{sf}/events.parquet")
            .withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
            .select("user_id", "event_id", "us", *cols))


def signal(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Events with their 0-based position ``n`` and the sequence length ``total``."""
    return number_rows(events(spark, sf, *cols), KEY, ORDER, day(), pos="n", total="total")
