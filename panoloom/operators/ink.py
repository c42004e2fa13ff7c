"""Sparse ink: packing to one row per frame, content and change measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoloom.operators.segments import previous
from panoloom.settings import DIFF_LEVEL, SEGMENT_ROWS

FRAME = ["video_id", "frame_idx"]
WORD = 64


def words(height: int) -> int:
    """64-bit words per column."""
    return (height + WORD - 1) // WORD


def frame_segment() -> Column:
    return F.expr(f"frame_idx div {SEGMENT_ROWS}")


def pack(marks: DataFrame, height: int) -> DataFrame:
    """Dense ``(video_id, frame_idx, y, x, on)`` to one row per frame.

    ``cols`` holds each column as bit words, left to right. A frame of any content packs to the same
    few kilobytes, which is what matching and folding move around instead of pixels.
    """
    n = words(height)
    bit = F.when(F.col("on"), F.expr(f"shiftleft(1L, cast(y % {WORD} as int))")).otherwise(F.lit(0).cast("bigint"))
    slots = (marks.groupBy(*FRAME, F.expr(f"cast(x * {n} + y div {WORD} as int)").alias("slot"))
             .agg(F.bit_or(bit).alias("bits")))
    return (slots.groupBy(*FRAME)
            .agg(F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("s"))
            .select(*FRAME, F.col("s.bits").alias("cols")))


def ink_count(cols: Column) -> Column:
    return F.aggregate(cols, F.lit(0).cast("bigint"), lambda a, c: a + F.bit_count(c))


def content_ratio(frames: DataFrame, ink: DataFrame, area: int) -> DataFrame:
    """Set pixels over all pixels, 0 for frames without ink."""
    n = ink.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_ink"))
    return (frames.select(*FRAME).join(n, FRAME, "left")
            .withColumn("n_ink", F.coalesce("n_ink", F.lit(0)).cast("bigint"))
            .withColumn("ratio", F.col("n_ink") / area))


def pack_gray(px: DataFrame) -> DataFrame:
    """One row per frame with its gray values in row-major order."""
    return (px.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
            .select(*FRAME, F.col("s.v").alias("gray")))


def change_ratio(px: DataFrame, level: int = DIFF_LEVEL) -> DataFrame:
    """Share of pixels that differ by more than ``level`` from the previous frame."""
    pairs = previous(pack_gray(px), ["video_id"], ["frame_idx"], frame_segment(), ["frame_idx", "gray"])
    changed = F.expr(f"aggregate(zip_with(gray, prev_gray, (a, b) -> if(abs(a - b) > {level}, 1, 0)), 0L, (s, d) -> s + d)")
    return (pairs.where("prev_frame_idx is not null")
            .select(*FRAME, "prev_frame_idx", changed.alias("n_changed"), F.size("gray").alias("n_px"))
            .withColumn("ratio", F.col("n_changed") / F.col("n_px")))


def unpack(packed: DataFrame, height: int) -> DataFrame:
    """Packed frames back to set pixels."""
    n = words(height)
    on = F.expr(f"filter(sequence(0, {WORD - 1}), i -> shiftright(bits, i) & 1 = 1)")
    return (packed.select(*FRAME, F.posexplode("cols").alias("slot", "bits")).where("bits <> 0")
            .select(*FRAME, "slot", F.explode(on).alias("i"))
            .select(*FRAME, F.expr(f"cast(slot % {n} * {WORD} + i as int)").alias("y"),
                    F.expr(f"cast(slot div {n} as int)").alias("x")))
