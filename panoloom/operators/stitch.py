"""From decision logs to strips, panorama and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoloom.operators.ink import frame_segment
from panoloom.operators.segments import running_sums
from panoloom.settings import CHUNK_MIN, CHUNK_NAME


def canvas_offsets(log: DataFrame, width: int | Column) -> DataFrame:
    """``(video_id, strip_no, frame_idx, src_x, width, canvas_x)`` in canvas order, and ``frame_w`` where ``width`` is a column.

    The seed strip is the last refresh before the first commit. ``log`` is read twice, so callers
    hand in a stored one.
    """
    log, a = log.withColumn("frame_w", F.lit(width)), F.col("action")
    seed = (log.where(a.isin("seed", "refresh")).groupBy("video_id")
            .agg(F.max("frame_idx").alias("frame_idx"), F.max("frame_w").alias("frame_w")).withColumn("width", F.col("frame_w")))
    added = log.where(a.isin("scroll", "page")).select("video_id", "frame_idx", "frame_w", F.col("strip_w").alias("width"))
    s = running_sums(seed.unionByName(added), ["video_id"], ["frame_idx"], frame_segment(),
                     {"strip_no": F.lit(1), "canvas_x": F.col("width")}, exclusive=True)
    return s.select("video_id", "strip_no", "frame_idx", (F.col("frame_w") - F.col("width")).alias("src_x"),
                    "width", "canvas_x", *(["frame_w"] if isinstance(width, Column) else []))


def strip_pixels(strips: DataFrame, px: DataFrame) -> DataFrame:
    """Pixels each strip contributes, still in frame coordinates."""
    return px.join(strips, ["video_id", "frame_idx"]).where("x >= src_x")


def panorama(strips: DataFrame, px: DataFrame) -> DataFrame:
    """The stitched image ``(video_id, y, x, v)``; placing pixels needs no shuffle after the join."""
    return strip_pixels(strips, px).select("video_id", "y", (F.col("canvas_x") + F.col("x") - F.col("src_x")).alias("x"), "v")


def _chunks(spans: DataFrame, width: int | str) -> DataFrame:
    """Chunk table from ``(video_id, chunk_no, x1)``; a remainder below the minimum gives no chunk."""
    spans = spans.withColumn("__w", F.expr(str(width)))
    x0 = F.col("chunk_no") * F.col("__w")
    return (spans.groupBy("video_id", "chunk_no").agg(F.max("x1").alias("x1"), F.max("__w").alias("__w"))
            .select("video_id", "chunk_no", F.format_string(CHUNK_NAME, "chunk_no").alias("name"), x0.alias("x0"),
                    (F.col("x1") - x0).cast("int").alias("w"), "__w")
            .where(F.col("w") >= CHUNK_MIN).withColumn("pad", F.col("__w") - F.col("w")).drop("__w"))


def chunks(strips: DataFrame, width: int | str) -> DataFrame:
    """Chunks of a panorama from its strips alone; no pixel is read. ``width`` is a number or the column that holds each video's."""
    end = F.col("canvas_x") + F.col("width")
    cover = F.expr(f"sequence(canvas_x div {width}, (canvas_x + width - 1) div {width})")
    keep = ["frame_w"] if isinstance(width, str) else []
    return _chunks(strips.select("video_id", *keep, F.explode(cover).alias("chunk_no"), end.alias("end"))
                   .select("video_id", *keep, "chunk_no", F.least("end", (F.col("chunk_no") + 1) * F.expr(str(width))).alias("x1")), width)


def pano_chunks(pano: DataFrame, width: int) -> DataFrame:
    """Chunks of a panorama given as pixels."""
    return _chunks(pano.select("video_id", F.expr(f"x div {width}").alias("chunk_no"), (F.col("x") + 1).alias("x1")), width)


def chunk_pixels(pano: DataFrame, width: int, paper: int = 255) -> DataFrame:
    """Pixels of every chunk, the last one filled up with white to full width.

    Keyed by ``(video_id, chunk_no)``: each chunk learns its own width, no video-wide value is needed.
    """
    p = pano.select("video_id", F.expr(f"x div {width}").alias("chunk_no"), "y", F.expr(f"cast(x % {width} as int)").alias("x"), "v")
    w = F.max("x").over(Window.partitionBy("video_id", "chunk_no")) + 1
    p = p.withColumn("__w", w).where(F.col("__w") >= CHUNK_MIN)
    me = F.array(F.struct("x", "v"))
    fill = F.transform(F.expr(f"sequence(__w, {width - 1})"), lambda c: F.struct(c.alias("x"), F.lit(paper).alias("v")))
    edge = (F.col("x") == F.col("__w") - 1) & (F.col("__w") < width)
    return p.select("video_id", "chunk_no", "y", F.inline(F.when(edge, F.concat(me, fill)).otherwise(me)))
