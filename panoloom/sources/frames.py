"""Decoded frames at rest: one row per frame, pixel planes as arrays.

A pixel table is some forty times larger than its planes, so frames are stored, read and shuffled as
rows of planes, and unfolded to pixels only inside the task that works on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.operators.segments import spread

FRAME = ["video_id", "frame_idx"]
SCHEMA = ("video_id BIGINT, frame_idx BIGINT, ts_us BIGINT, width INT, height INT, layout STRING, "
          "c0 ARRAY<SMALLINT>, c1 ARRAY<SMALLINT>, c2 ARRAY<SMALLINT>")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fault(layout: str = "layout") -> Column:
    """Why a stored frame cannot be used, null if it can: unknown layout, no size, or a plane of another length."""
    area = F.col("width") * F.col("height")
    used = {"c0": F.lit(True), "c1": F.col(layout) != "GRAY", "c2": F.col(layout) != "GRAY"}
    short = [F.when(need & ~F.coalesce(F.size(p) == area, F.lit(False)), F.lit(f"plane {p} has another size")) for p, need in used.items()]
    return (F.when(~F.coalesce(F.col(layout).isin("BGR", "RGB", "GRAY"), F.lit(False)), "unknown layout")
            .when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "no size")
            .otherwise(F.coalesce(*short)))


def bad_frames(frames: DataFrame) -> DataFrame:
    """``(video_id, frame_idx, reason)`` of the stored frames that ``normalise`` leaves out."""
    return frames.select(*FRAME, fault().alias("reason")).where("reason is not null")


def normalise(frames: DataFrame) -> DataFrame:
    """Planes ``b, g, r`` whatever the stored layout (BGR, RGB or GRAY); for frames without a ``fault``."""
    rgb, gray = F.col("layout") == "RGB", F.col("layout") == "GRAY"
    return (frames.where(fault().isNull())
            .select(*FRAME, "ts_us", "width", "height",
                    F.when(rgb, F.col("c2")).otherwise(F.col("c0")).alias("b"),
                    F.when(gray, F.col("c0")).otherwise(F.col("c1")).alias("g"),
                    F.when(rgb | gray, F.col("c0")).otherwise(F.col("c2")).alias("r")))


def crop(frames: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Normalised frames cut to a rectangle inside each, by slices of rows; no pixel table, no shuffle."""
    rect = frames.select("*", *[v.cast("int").alias(f"__c{n}") for n, v in zip("xywh", (x, y, w, h))])
    part = ("flatten(transform(sequence(__cy, __cy + __ch - 1), j -> slice({p}, j * width + __cx + 1, __cw)))")
    return rect.where("__cw > 0 and __ch > 0").select(
        *[c for c in frames.columns if c not in ("width", "height", "b", "g", "r")],
        F.col("__cw").alias("width"), F.col("__ch").alias("height"), *[F.expr(part.format(p=p)).alias(p) for p in "bgr"])


def unfold(frames: DataFrame) -> DataFrame:
    """Pixels ``(video_id, frame_idx, y, x, b, g, r)`` of normalised frames, co-located by frame."""
    return (spread(frames, *FRAME)
            .select(*FRAME, "width", F.posexplode(F.arrays_zip("b", "g", "r")).alias("i", "p"))
            .select(*FRAME, F.expr("cast(i div width as int)").alias("y"), F.expr("i % width").alias("x"),
                    *[F.col(f"p.{c}").cast("int").alias(c) for c in "bgr"]))


def store(bgr: DataFrame, width: int, height: int, layout: str = "BGR") -> DataFrame:
    """Pixels back to frame rows in the stored schema; timestamps are joined by the caller if known."""
    px = F.sort_array(F.collect_list(F.struct("y", "x", "b", "g", "r")))
    rows = bgr.groupBy(*FRAME).agg(px.alias("p"))
    planes = ["r", "g", "b"] if layout == "RGB" else ["b", "g", "r"]
    return rows.select(*FRAME, F.lit(None).cast("bigint").alias("ts_us"), F.lit(width).alias("width"),
                       F.lit(height).alias("height"), F.lit(layout).alias("layout"),
                       *[F.col(f"p.{c}").cast("array<smallint>").alias(f"c{i}") for i, c in enumerate(planes)])
