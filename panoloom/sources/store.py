"""Frames clustered by (video, time), so that slices and single frames open few files.

Files hold consecutive ranges of (video, time), sorted inside, with small row groups. An index with one row per file and video in it says which times it holds; a
lookup takes its files from the index and its row groups by pushed filters. The index grows with the number of files and videos, not of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.session import stored

ROW_GROUP_BYTES = 8 << 20


def write_store(frames: DataFrame, path: str, files: int, row_group: int = ROW_GROUP_BYTES) -> None:
    """``frames`` (``video_id, ts_us, …``) in about ``files`` files and their index beside them."""
    (frames.repartitionByRange(files, "video_id", "ts_us").sortWithinPartitions("video_id", "ts_us")
     .write.option("parquet.block.size", row_group).parquet(f"{path}/frames"))
    rows = frames.sparkSession.read.parquet(f"{path}/frames").select("video_id", "ts_us", F.input_file_name().alias("file"))
    (rows.groupBy("video_id", "file").agg(F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"), F.count(F.lit(1)).alias("n"))
     .write.parquet(f"{path}/index"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _open(spark: SparkSession, path: str, files: DataFrame, low, high) -> DataFrame:
    """The frames of the named files; file names go to the driver as those of any scan do."""
    names = [r["file"] for r in files.select("file").distinct().collect()]
    schema = spark.read.parquet(f"{path}/frames").schema
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return rows if low is None else rows.where(F.col("video_id").between(low, high))       # pushed to the row groups


def slices(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Frames with ``first_us <= ts_us <= last_us`` for the rows ``video_id, first_us, last_us`` of ``wanted``; a null bound is open."""
    w = wanted.select("video_id", F.coalesce("first_us", F.lit(-(1 << 62))).alias("first_us"), F.coalesce("last_us", F.lit(1 << 62)).alias("last_us"))
    low, high = w.agg(F.min("video_id"), F.max("video_id")).first()
    files = read_index(spark, path).join(w, "video_id").where("from_us <= last_us and to_us >= first_us")
    rows = _open(spark, path, files, low, high)
    return rows.join(w, "video_id").where("ts_us between first_us and last_us").drop("first_us", "last_us")


def frames_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The first frame at or after ``at_us`` for each row ``video_id, at_us`` of ``wanted``, with ``at_us``; a row without such a frame gives none."""
    w = stored(wanted.select("video_id", "at_us").distinct(), "wanted")
    # a video's files are in order of time: the first one that ends at or after the place holds the frame
    asked = read_index(spark, path).join(w, "video_id").where("to_us >= at_us")
    files = asked.groupBy("video_id", "at_us").agg(F.min_by("file", "to_us").alias("file"))
    low, high = w.agg(F.min("video_id"), F.max("video_id")).first()
    rows = _open(spark, path, files, low, high)
    found = rows.join(w, "video_id").where("ts_us >= at_us")
    rest = [c for c in rows.columns if c not in ("video_id", "ts_us")]
    return found.groupBy("video_id", "at_us").agg(F.min(F.struct("ts_us", *rest)).alias("r")).select("video_id", "at_us", "r.*")
