"""Sinks for chunks and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoloom.settings import CHUNK_NAME


CHUNKS_PER_FILE = 64


def write_chunks(pixels: DataFrame, path: str) -> None:
    """One row per chunk ``(video_id, chunk_no, name, v)`` with its gray values in row-major order.

    A chunk is bounded by its size, so it may be one row. Rows of a video lie together, in stretches of ``CHUNKS_PER_FILE``, so that readers
    of one video skip other files by their statistics; there is no folder per video.
    """
    chunk = F.sort_array(F.collect_list(F.struct("y", "x", "v")))
    (pixels.groupBy("video_id", "chunk_no").agg(chunk.alias("p"))
     .select("video_id", "chunk_no", F.format_string(CHUNK_NAME, "chunk_no").alias("name"), F.col("p.v").alias("v"))
     .repartition("video_id", F.expr(f"chunk_no div {CHUNKS_PER_FILE}")).sortWithinPartitions("video_id", "chunk_no")
     .write.mode("overwrite").parquet(path))


def read_chunks(spark, path: str, width: int) -> DataFrame:
    """Pixels of stored chunks."""
    rows = spark.read.parquet(path).select("video_id", "chunk_no", F.posexplode("v").alias("i", "v"))
    return rows.selectExpr("video_id", "chunk_no", f"cast(i div {width} as int) as y", f"cast(i % {width} as int) as x", "v")


def write_layout(layout: DataFrame, path: str, doc: str, pages: int = 1024) -> None:
    """Layout rows of a document together, in reading order, ``pages`` pages of it to a file at most."""
    (layout.repartition(doc, F.expr(f"page_no div {pages}")).sortWithinPartitions(doc, "n")
     .write.mode("overwrite").parquet(path))
