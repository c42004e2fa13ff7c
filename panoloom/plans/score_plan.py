"""The whole pipeline as queries, with the whole pipeline in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panoloom.plans import fold_plan as fp
from panoloom.plans import score as pp
from panoloom.plans import raster_plan as rp
from panoloom.plans import stitch_plan as sp
from panoloom.plans.common import BGR, FRAMES, registry
from panoloom.plans.match_plan import BAND
from panoloom.session import fresh_path, stored
from panoloom.sources import camera as cam
from panoloom.sources import frames as fr
from panoloom.sources import images
from panoloom.sources import planar
from panoloom.sources import sinks
from panoloom.sources import store
from panoloom.sources.ledger import Ledger

QUERIES, ORACLE, query = registry()


def _renamed(sql: str, names: str, prefix: str) -> str:
    """The same CTEs under other names, so two variants fit in one statement."""
    return re.sub(rf"\b({'|'.join(names.split())})(?=\b|_)", rf"{prefix}\1", sql)


_FEATURE_NAMES = "pol bh th fbin feat ad kern"
_LOG = f"""{BGR}, {_renamed(rp.FEATURE_TRANSLUCENT, _FEATURE_NAMES, 't')}, {_renamed(rp.FEATURE_OPAQUE, _FEATURE_NAMES, 'o')},
ink as materialized (select * from tfeat), oink as materialized (select * from ofeat), {fp.SCROLL_STEPS},
{_renamed(fp.SIMS, 'nums same sims ink', 'o')}, {_renamed(_renamed(fp.PAGE_STEPS, 'sims', 'o'), 'fold', 'p')},
log as (select * from fold where video_id % 2 = 0 union all select * from pfold where video_id % 2 = 1)"""
_STITCHED = f"{_LOG}, {sp._STRIPS}, {sp._STITCHED.replace('from px p', 'from gray p')}"

_CLEAN_T = f"{rp._pano_pol(100)}, {rp.CLAHE}, {rp._blackhat('eq', 'bh', 'video_id')}, {rp.FLOORED}, {rp._despeckle('floored', 'kept')}, paper as ({rp._paper('floored')})"
_CLEAN_O = (f"{rp._pano_pol(110)}, {rp._adaptive('pol', 'ad', 'video_id, mx, my', 'p.mx', 'p.my')}, "
            f"marked as materialized (select video_id, y, x, v from ad), {rp._despeckle('marked', 'kept')}, paper as ({rp._paper('marked')})")
_CLEAN_NAMES = ("pano pol cp ct ch ce cd lut cm cw cr eq bh floored around kept paper ad kern marked "
                + " ".join(f"sl{i}" for i in range(8)))
_CLEAN = f"""ptpano as (select * from stitched where video_id % 2 = 0), popano as (select * from stitched where video_id % 2 = 1),
{_renamed(_CLEAN_T, _CLEAN_NAMES, 'pt')}, {_renamed(_CLEAN_O, _CLEAN_NAMES, 'po')},
cleaned as materialized (select video_id, y, x, b as v from ptpaper union all select video_id, y, x, b from popaper)"""


MODE = "case when video_id % 2 = 1 then 'opaque' end"


def _log(spark, sf):
    return pp.decide(cam.planes(spark, sf), BAND, F.expr(MODE))


@query(f"with recursive {_LOG} select video_id, frame_idx, action, dx, peak, zero, strip_w, vetoed from log")
def score_log(spark, sf):
    return _log(spark, sf)


@query(f"with recursive {_STITCHED}, {_CLEAN}, {sp._chunks_sql('cleaned')}, {sp.PADDED.format(src='cleaned')}")
def score_chunks(spark, sf):
    return pp.pixels_of(cam.planes(spark, sf), pp.strips_of(_log(spark, sf), BAND), BAND, F.expr(MODE))


@query(f"""with recursive {_STITCHED}, {sp._chunks_sql('stitched')},
items as (select video_id, row_number() over (partition by video_id order by chunk_no) - 1 as n, 64 as img_w, 16 as img_h from chunks),
{sp._layout_sql('video_id', 'items')} select * from pages_out""")
def score_pages(spark, sf):
    return pp.pages_of(pp.strips_of(_log(spark, sf), BAND), BAND)


# jobs of every fate: modes with spaces, an unknown mode, a truncated plane, a region beyond the frame, blank frames of another size, no frames,
# frames of two sizes, a step of 0, a video asked for twice
JOBS = [(0, None), (1, " Opaque "), (2, "typo"), (3, "opaque"), (4, "translucent"), (5, None), (6, None), (7, None), (8, "opaque"), (8, None), (9, None)]


def _job(video, mode):
    region = (-3, 0, 100, 50) if video == 4 else (500, 0, 10, 10) if video == 0 else (None,) * 4
    return video, mode, 0 if video == 7 else None, None, None, *region


@query(f"""with recursive {_STITCHED}, {sp._chunks_sql('stitched')},
jobs as (select * from (values (0, null), (1, null), (2, 'unknown mode'), (3, 'plane c1 has another size'), (4, null), (5, null),
  (6, 'frames of several sizes'), (7, 'every must be at least 1'), (8, 'video given more than once'), (8, 'video given more than once'), (9, null)) as t(video_id, error)),
made as (select video_id, count(*) as n_chunks from chunks group by all)
select cast(j.video_id as bigint) as video_id, case when error is not null then 'failed' when coalesce(n_chunks, 0) = 0 then 'empty' else 'ok' end as status, error,
  case when error is null then coalesce(n_chunks, 0) else 0 end as n_chunks from jobs j left join made using (video_id)""")
def score_status(spark, sf):
    jobs = spark.createDataFrame([_job(v, m) for v, m in JOBS],
                                 "video_id long, mode string, every int, first_us long, last_us long, x int, y int, w int, h int")
    broken = F.expr("video_id = 3 and frame_idx = 5")
    frames = cam.planes(spark, sf).select("video_id", "frame_idx", "ts_us", "width", "height", F.lit("BGR").alias("layout"), F.col("b").alias("c0"),
                                          F.when(broken, F.slice("g", 1, 100)).otherwise(F.col("g")).alias("c1"), F.col("r").alias("c2"))
    first = frames.where("video_id = 0 and frame_idx < 4")
    paper = F.array_repeat(F.lit(200).cast("smallint"), 50 * 10)
    small = first.withColumns({"width": F.lit(50), "height": F.lit(10), "c0": paper, "c1": paper, "c2": paper})
    blank = small.withColumn("video_id", F.lit(5).cast("bigint"))
    mixed = small.where("frame_idx < 2").unionByName(first.where("frame_idx >= 2")).withColumn("video_id", F.lit(6).cast("bigint"))
    frames = frames.unionByName(blank).unionByName(mixed)
    return pp.run_job(jobs, frames)[0]


@query(f"""with recursive {_STITCHED}, {sp._chunks_sql('stitched')}
select video_id, 'ok' as status, count(*) as n_chunks from chunks group by video_id""")
def score_ledger(spark, sf):
    # two videos first, then all in waves of two: the first two are taken from the ledger; stored frames, since every wave reads them
    frames = stored(cam.planes(spark, sf).withColumnsRenamed({"b": "c0", "g": "c1", "r": "c2"}).withColumn("layout", F.lit("BGR")), "frames")
    jobs = cam.vectors(spark, sf).select("video_id").distinct().withColumn("mode", F.expr(MODE)).selectExpr(
        "*", *[f"cast(null as {t}) as {c}" for c, t in zip(("every", "first_us", "last_us", *"xywh"), ("int", "bigint", "bigint", *["int"] * 4))])
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    ledger.run(jobs.where("video_id < 2"), frames, pp.run_job)
    return ledger.run(jobs, frames, pp.run_job, wave=2).select("video_id", "status", "n_chunks")


@query(f"""with {BGR} select video_id, frame_idx // 3 as frame_idx, y - 4 as y, x - 8 as x, b, g, r from bgr
where frame_idx % 3 = 0 and frame_idx * 50000 >= 500000 and x >= 8 and x < 48 and y >= 4 and y < 13""")
def prepared_frames(spark, sf):
    # every third frame from half a second on, a region of 40 by 9 pixels
    jobs = cam.vectors(spark, sf).groupBy("video_id").agg(F.lit("opaque").alias("mode")).selectExpr(
        "*", "3 as every", "500000L as first_us", "cast(null as bigint) as last_us", "8 as x", "4 as y", "40 as w", "9 as h")
    frames = cam.planes(spark, sf).withColumnsRenamed({"b": "c0", "g": "c1", "r": "c2"}).withColumn("layout", F.lit("BGR"))
    return fr.unfold(pp.prepare(frames, jobs))


def clustered(spark, sf, files=12):
    path = fresh_path(spark, "store")
    store.write_store(cam.planes(spark, sf), path, files)
    return path


@query(f"""with {FRAMES} select video_id, frame_idx, ts_us from frames where ts_us between 1000000 + video_id * 200000 and 2500000""")
def time_slice_store(spark, sf):
    wanted = cam.vectors(spark, sf).select("video_id").distinct().selectExpr("video_id", "1000000 + video_id * 200000 as first_us", "2500000L as last_us")
    return store.slices(spark, clustered(spark, sf), wanted).select("video_id", "frame_idx", "ts_us")


@query(f"""with {FRAMES}, ends as (select video_id, max(ts_us) as ts_end from frames group by video_id),
wanted as (select video_id, cast(floor(ts_end * p) as bigint) as at_us from ends, (values (0.2::double), (0.4::double), (0.6::double), (0.8::double)) t(p))
select w.video_id, w.at_us, min(f.frame_idx) as frame_idx, min(f.ts_us) as ts_us from wanted w join frames f on f.video_id = w.video_id and f.ts_us >= w.at_us group by all""")
def frame_at_store(spark, sf):
    path = clustered(spark, sf)
    ends = cam.planes(spark, sf).groupBy("video_id").agg(F.max("ts_us").alias("ts_end"))
    wanted = ends.select("video_id", F.explode(F.array(*[F.floor(F.col("ts_end") * F.lit(p)) for p in (0.2, 0.4, 0.6, 0.8)])).alias("at_us"))
    return store.frames_at(spark, path, wanted).select("video_id", "at_us", "frame_idx", "ts_us")


@query(sp.ORACLE["slice_padded"])
def chunks_roundtrip(spark, sf):
    path = fresh_path(spark, "chunks")
    sinks.write_chunks(sp.QUERIES["slice_padded"](spark, sf), path)
    return sinks.read_chunks(spark, path, cam.W)


@query(sp.ORACLE["slice_padded"])
def chunk_files_roundtrip(spark, sf):
    # one image file per chunk, committed together
    spark.dataSource.register(images.ChunkFiles)
    path = fresh_path(spark, "images")
    images.chunk_rows(sp.QUERIES["slice_padded"](spark, sf)).write.format("chunk_files").option("path", path).mode("append").save()
    return images.chunk_pixels(spark.read.format("chunk_files").option("path", path).load())


@query(sp.ORACLE["stitch_layout"])
def layout_roundtrip(spark, sf):
    path = fresh_path(spark, "layout")
    sinks.write_layout(sp.QUERIES["stitch_layout"](spark, sf), path, "video_id")
    return spark.read.parquet(path)


@query(f"with {BGR} select * from bgr")
def frames_roundtrip(spark, sf):
    path = fresh_path(spark, "frames")
    fr.store(cam.bgr(spark, sf), cam.W, cam.H).write.parquet(path)
    return fr.unfold(fr.normalise(fr.read_frames(spark, path)))


@query(f"with {BGR} select * from bgr")
def frames_source(spark, sf):
    # planar files by a data source of their own
    path = fresh_path(spark, "planar")
    planar.write_planar(fr.store(cam.bgr(spark, sf), cam.W, cam.H), path)
    return fr.unfold(fr.normalise(planar.read_planar(spark, path)))


@query(f"with {BGR} select * from bgr where video_id in (1, 3) and frame_idx between 10 and 40")
def frames_source_slice(spark, sf):
    # video and frame range are applied by the source
    path = fresh_path(spark, "planar")
    planar.write_planar(fr.store(cam.bgr(spark, sf), cam.W, cam.H), path)
    return fr.unfold(fr.normalise(planar.read_planar(spark, path).where("video_id in (1, 3) and frame_idx between 10 and 40")))
