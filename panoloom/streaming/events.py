"""Streaming progress and log routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoloom.functions.text import route_line
from panoloom.settings import PROGRESS_SECONDS


def progress_stream(events: DataFrame, key: str, ts: str, counts: dict[str, Column], delay: str = "10 seconds",
                    seconds: int = PROGRESS_SECONDS) -> DataFrame:
    """Counts per key and tumbling window, for update mode: a window's row is sent anew whenever it grows.

    State goes once the watermark has passed a window. ``runner.drain_updates`` keeps the last row of each, open windows included.
    """
    t = events.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", delay)
    return (t.groupBy(key, F.window("t", f"{seconds} seconds"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(o) for o, c in counts.items()])
            .withColumn("start_us", F.unix_micros("window.start")).drop("window"))


def routed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with their route and payload; write it partitioned by ``route`` to split the stream in one pass."""
    return lines.withColumn("r", route_line(F.col(line))).select(
        *[c for c in lines.columns if c != line], "r.route", "r.payload")
