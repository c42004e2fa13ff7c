"""Stored frames to finished pages, for many videos at once.

Shuffles, in order: none for features (a map over frames); packed ink by (video, segment) for the
fold; committed frames only, joined with their strips; panorama columns by (video, tile) for the
clean-up; chunks by (video, chunk). Pixels of frames that add nothing are never unfolded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoloom.functions.geometry import safe_rect
from panoloom.operators import fold, layout, planes, raster, steps, stitch
from panoloom.operators.jobs import OPAQUE, TRANSLUCENT, job_status, sheet_mode
from panoloom.operators.match import Band
from panoloom.session import settle, stored
from panoloom.sources import frames as fr


def decide(frames: DataFrame, band: Band, mode: Column) -> DataFrame:
    """Decision log of normalised frames of one size, each video in its own mode; stored once."""
    f = frames.withColumn("mode", sheet_mode(mode))
    scroll = fold.scroll_fold(planes.features(f.where(F.col("mode") == TRANSLUCENT)), band)
    pages = fold.page_fold(planes.features(f.where(F.col("mode") == OPAQUE), opaque=True), band)
    return settle(scroll.unionByName(pages))


def checked(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``mode`` read and ``error``: why a job cannot run by its own parameters, else null."""
    same = Window.partitionBy("video_id")
    error = (F.when(F.count(F.lit(1)).over(same) > 1, "video given more than once")
             .when(sheet_mode(F.col("mode")).isNull(), "unknown mode")
             .when(F.col("every") < 1, "every must be at least 1")
             .when(F.col("first_us") > F.col("last_us"), "no time between first_us and last_us"))
    return jobs.withColumn("error", error).withColumn("mode", sheet_mode(F.col("mode")))


def region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A job's region within its frames: cut to the frame, or the whole frame where nothing of it lies inside. Nulls leave that side open."""
    x0, y0 = (F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)) for v in (x, y))
    x1 = F.least(F.coalesce(x, F.lit(0)) + F.coalesce(w, width), width)
    y1 = F.least(F.coalesce(y, F.lit(0)) + F.coalesce(h, height), height)
    return safe_rect(x0, y0, x1 - x0, y1 - y0, width, height)


def prepare(frames: DataFrame, jobs: DataFrame) -> DataFrame:
    """Normalised frames of the videos of ``jobs``, sampled and cut to their regions, with ``mode``.

    ``jobs`` has one row per video: ``video_id, mode, every, first_us, last_us, x, y, w, h``; nulls leave out the step. Sampled frames are
    numbered anew by their place, ``frame_idx div every``. All of it is a map over frames beside the join.
    """
    j = jobs.select(F.col("video_id").alias("__id"), sheet_mode(F.col("mode")).alias("mode"), F.coalesce("every", F.lit(1)).alias("every"),
                    "first_us", "last_us", *[F.col(v).alias(f"__{v}") for v in "xywh"])
    f = fr.normalise(frames).join(j, F.col("video_id") == F.col("__id"))
    f = f.where("frame_idx % every = 0 and (first_us is null or ts_us >= first_us) and (last_us is null or ts_us <= last_us)")
    f = f.withColumn("frame_idx", F.expr("frame_idx div every"))
    f = f.withColumn("__r", region(*[F.col(f"__{v}") for v in "xywh"], F.col("width"), F.col("height")))
    cut = fr.crop(f, *[F.col(f"__r.{v}") for v in "xywh"])
    return cut.select("video_id", "frame_idx", "ts_us", "width", "height", "b", "g", "r", "mode")


def status_of(jobs: DataFrame, errors: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """``video_id, status, error, n_chunks`` of every checked job: ``failed`` with the reason, ``empty`` or ``ok``."""
    found = errors.groupBy("video_id").agg(F.min("reason").alias("reason"))
    made = chunk_rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = jobs.select("video_id", "error").join(found, "video_id", "left").join(made, "video_id", "left")
    rows = rows.withColumn("error", F.coalesce("error", "reason"))
    return rows.select("video_id", job_status(F.col("error"), F.col("n_chunks")).alias("status"), "error",
                       F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


def run_job(jobs: DataFrame, frames: DataFrame, scroll: Callable = steps.scroll_step,
            page: Callable = steps.page_step) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, chunks, pages) of a manifest of jobs over stored frames.

    All videos run in one pass, whatever their sizes, regions, sampling and modes: a size is columns of the rows, and no part of the plan depends on how many
    there are. A job that fails (by its parameters, an unreadable frame, frames of several sizes, or an exception while folding) is a row of the
    status and stops no other; a region that leaves the frame is cut to it.
    """
    asked = settle(checked(jobs))
    able = asked.where("error is null").drop("error")
    frames = frames.join(able.select("video_id"), "video_id", "left_semi")
    bad = settle(fr.bad_frames(frames).groupBy("video_id").agg(F.min("reason").alias("reason")))
    ready = stored(prepare(frames.join(bad, "video_id", "left_anti"), able), "ready")
    sizes = ready.groupBy("video_id").agg(F.count_distinct("width", "height").alias("n"), F.max("width").alias("frame_w"), F.max("height").alias("frame_h"))
    sizes = settle(sizes)
    mixed = sizes.where("n > 1").select("video_id", F.lit("frames of several sizes").alias("reason"))
    ready = ready.join(mixed, "video_id", "left_anti")
    log = (fold.sized_fold(planes.features(ready.where(F.col("mode") == TRANSLUCENT)), scroll)
           .unionByName(fold.sized_fold(planes.features(ready.where(F.col("mode") == OPAQUE), opaque=True), page)))
    log = settle(log)
    broken = log.where("error is not null").groupBy("video_id").agg(F.min("error").alias("reason"))
    whole = log.join(broken, "video_id", "left_anti").join(sizes.select("video_id", F.col("frame_w").alias("w_of")), "video_id")
    strips = settle(stitch.canvas_offsets(whole, F.col("w_of")))
    made = settle(stitch.chunks(strips, "frame_w"))
    sized = made.join(sizes.select("video_id", F.col("frame_w").alias("img_w"), F.col("frame_h").alias("img_h")), "video_id")
    errors = bad.unionByName(mixed).unionByName(broken)
    return status_of(asked, errors, made), made, layout.page_layout_pointers(sized, "video_id", "chunk_no", "img_w", "img_h")


def strips_of(log: DataFrame, band: Band) -> DataFrame:
    """What each commit added to its canvas; small, and read by everything that follows."""
    return settle(stitch.canvas_offsets(log, band.width))


def pages_of(strips: DataFrame, band: Band) -> DataFrame:
    """Page placement of the chunks; needs no pixels."""
    sized = (stitch.chunks(strips, band.width)
             .withColumn("img_w", F.lit(band.width)).withColumn("img_h", F.lit(band.height)))
    return layout.page_layout(sized, "video_id", "chunk_no", "img_w", "img_h")


def pixels_of(frames: DataFrame, strips: DataFrame, band: Band, mode: Column) -> DataFrame:
    """Cleaned chunk pixels; only frames that contribute a strip are unfolded.

    The panorama is written once: statistics, histograms and the clean-up itself each read it.
    """
    used = frames.join(strips.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_semi")
    pano = stored(stitch.panorama(strips, raster.luma(fr.unfold(used))).withColumn("mode", sheet_mode(mode)), "pano")
    clean = (raster.clean_translucent(pano.where(F.col("mode") == TRANSLUCENT).drop("mode"))
             .unionByName(raster.clean_opaque(pano.where(F.col("mode") == OPAQUE).drop("mode"))))
    return stitch.chunk_pixels(clean.withColumnRenamed("b", "v").drop("g", "r"), band.width)
