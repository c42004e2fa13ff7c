"""Sampling, time slicing and point lookup on ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoloom.operators.segments import key_totals, running_sums
from panoloom.settings import (CONTENT_MIN, LEGACY_FPS, LEGACY_PROGRESS_SECONDS, PREVIEW_SECONDS,
                               PROGRESS_SECONDS, SCAN_FPS)


def duration_us(length_us: Column, n_frames: Column, fps: Column, unknown: int) -> Column:
    """Container length, else frames over rate, else ``unknown``."""
    by_count = F.floor(n_frames / fps * F.lit(1e6)).cast("bigint")
    return F.coalesce(F.when(length_us > 0, length_us),
                      F.when((fps > 0) & (n_frames > 0), by_count), F.lit(unknown).cast("bigint"))


def video_meta(df: DataFrame) -> DataFrame:
    scan = duration_us(F.col("length_us"), F.col("n_frames"), F.col("fps"), 0)
    preview = duration_us(F.col("length_us"), F.col("n_frames"), F.col("fps"), int(PREVIEW_SECONDS * 1e6))
    return (df.withColumn("duration_us", scan)
            .withColumn("duration_sec", F.col("duration_us") / F.lit(1e6))
            .withColumn("preview_us", preview))


def frame_skip(fps: Column, scan_fps: int = SCAN_FPS) -> Column:
    rate = F.when(fps > 0, fps).otherwise(float(scan_fps))
    return F.greatest(F.lit(1), F.floor(rate / scan_fps + 0.5)).cast("bigint")


def sample_every(numbered: DataFrame, fps: Column, present: Column) -> DataFrame:
    """Every k-th frame; absent frames are dropped after numbering, so they still use up a number."""
    return (numbered.withColumn("k", frame_skip(fps))
            .where("n % k = 0")
            .withColumn("sample_idx", F.expr("n div k"))
            .where(present))


def sample_keep_last(numbered: DataFrame, fps: Column, rate: int = LEGACY_FPS) -> DataFrame:
    """Every step-th frame and always the last; needs columns ``n`` and ``total``."""
    step = F.greatest(F.lit(1), (fps / rate).cast("bigint")).cast("bigint")
    return numbered.withColumn("step", step).where("n % step = 0 or n = total - 1")


def time_slice(df: DataFrame, us: str, start_sec: float = 0, end_sec: float = 0) -> DataFrame:
    """Rows of the [start, end] slice; a bound of 0 is no bound."""
    if start_sec > 0:
        df = df.where(F.col(us) >= int(start_sec * 1e6))
    if end_sec > 0:
        df = df.where(F.col(us) <= end_sec * 1e6)
    return df


def with_span(df: DataFrame, keys: list[str], us: str, seg: Column) -> DataFrame:
    """Add ``rel_us`` (time since the first row) and ``span_us`` of the sequence."""
    t = key_totals(df, keys, seg, {"__first": (F.min, F.col(us)), "__last": (F.max, F.col(us))})
    return (t.withColumn("rel_us", F.col(us) - F.col("__first"))
            .withColumn("span_us", F.col("__last") - F.col("__first")).drop("__first", "__last"))


def frame_at(df: DataFrame, key: str, row_id: str, positions) -> DataFrame:
    """Row at each relative position: by time (first at or after it) and by index.

    ``df`` has ``rel_us``, ``span_us``, ``n`` and ``total``. One aggregation, whatever the sequence size.
    """
    picks = []
    for p in positions:
        target = F.floor(F.col("span_us") * F.lit(p)).cast("bigint")
        index = F.floor(F.least(F.col("total") - 1, F.col("total") * F.lit(p))).cast("bigint")
        picks.append(F.struct(
            F.lit(p).alias("p"),
            F.min(F.when(F.col("rel_us") >= target, F.struct("rel_us", row_id)))[row_id].alias("by_time"),
            F.min(F.when(F.col("n") == F.greatest(F.lit(0), index), F.col(row_id))).alias("by_index")))
    return df.groupBy(key).agg(F.array(*picks).alias("__p")).select(key, F.inline("__p"))


def intro_skip(df: DataFrame, key: str, order: str, ratio: Column, seg: Column,
               least: float = CONTENT_MIN) -> DataFrame:
    """Drop rows before the first one with enough content; later blank rows stay."""
    first = F.when(ratio >= least, F.col(order))
    return (key_totals(df, [key], seg, {"__first": (F.min, first)})
            .where(F.col(order) >= F.col("__first")).drop("__first"))


def progress(numbered: DataFrame, keys: list[str], order: list, seg: Column, sums: dict[str, Column],
             scan_fps: int = SCAN_FPS, seconds: int = PROGRESS_SECONDS) -> DataFrame:
    """Running totals at every ``scan_fps * seconds``-th sample, the first one excepted."""
    every = scan_fps * seconds
    pct = F.when(F.col("span_us") > 0, F.col("rel_us") / F.col("span_us") * 100).otherwise(0.0)
    return (running_sums(numbered, keys, order, seg, sums)
            .where(f"n > 0 and n % {every} = 0")
            .withColumn("pct", F.greatest(pct, F.lit(0.0))))


def progress_by_frames(numbered: DataFrame, fps: Column, seconds: int = LEGACY_PROGRESS_SECONDS) -> DataFrame:
    """Legacy progress: every ``seconds`` of frames, with the share of frames done."""
    every = F.greatest(F.lit(1), (fps * seconds).cast("bigint"))
    return (numbered.where((F.col("n") > 0) & (F.col("n") % every == 0))
            .withColumn("pct", F.col("n") / F.col("total") * 100))


def target_stop(df: DataFrame, keys: list[str], order: list, seg: Column, done: Column,
                per_block: int, target: Column) -> DataFrame:
    """Rows up to the one that reaches the target; a target of 0 keeps all."""
    run = running_sums(df, keys, order, seg, {"blocks_before": done.cast("bigint")}, exclusive=True)
    return run.where((target <= 0) | (F.col("blocks_before") * per_block < target))


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The final row of each sequence."""
    cols = [c for c in df.columns if c not in (key, order)]
    return (df.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("__r"))
            .select(key, f"__r.{order}", *[f"__r.{c}" for c in cols]))


def flush_tail(last: DataFrame, overlap: Column, width: int, least: int) -> DataFrame:
    """What remains of each sequence's last screen beyond its overlap, if wide enough."""
    x0 = F.when(overlap != -1, overlap).otherwise(0)
    return (last.withColumn("x0", x0).withColumn("width", F.lit(width) - F.col("x0"))
            .where(F.col("width") > least))
