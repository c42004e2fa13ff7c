"""Queries over manifests, names, geometry and sampling, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panoloom.functions import geometry as g
from panoloom.functions import text as tx
from panoloom.operators import jobs, sampling, waves
from panoloom.plans.common import registry
from panoloom.session import fresh_path
from panoloom.settings import (DAY_US, LEGACY_FPS, MEASURES_PER_BLOCK, PREVIEW_POSITION, PROBE_POSITIONS,
                               TEXT_HEIGHT, TEXT_MAX_W, TEXT_MIN_W)
from panoloom.sources import manifest as mf
from panoloom.sources import signal as sg

QUERIES, ORACLE, query = registry()


SIGNAL = """signal as (
  select user_id, event_id, epoch_us(ts) as us, value, event_type,
         row_number() over (partition by user_id order by ts, event_id) - 1 as n,
         count(*) over (partition by user_id) as total,
         epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as rel_us,
         max(epoch_us(ts)) over (partition by user_id) - min(epoch_us(ts)) over (partition by user_id) as span_us
  from events)"""

URL_LINES = """lines as (
  select page_id, case when page_id % 11 = 10 then '   '
                       when page_id % 7 = 6 then '# ' || url
                       else '  ' || url || ' ' end as line from pages)"""


@query("""select user_id, n_frames, fps, length_us,
  cast(case when length_us > 0 then length_us when fps > 0 then floor(n_frames / fps * 1e6) else 0 end as bigint) as duration_us,
  cast(case when length_us > 0 then length_us when fps > 0 then floor(n_frames / fps * 1e6) else 0 end as bigint) / 1e6::double as duration_sec,
  cast(case when length_us > 0 then length_us when fps > 0 then floor(n_frames / fps * 1e6) else 30000000 end as bigint) as preview_us
from (select user_id, count(*) as n_frames, cast(user_id % 4 as double) * 12.5::double as fps,
             case when user_id % 3 = 0 then 0 else max(epoch_us(ts)) - min(epoch_us(ts)) end as length_us
      from events group by user_id)""")
def video_meta(spark, sf):
    per_user = sg.events(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_frames"), (F.max("us") - F.min("us")).alias("span"))
    return sampling.video_meta(per_user.selectExpr(
        "user_id", "n_frames", "cast(user_id % 4 as double) * 12.5D as fps",
        "case when user_id % 3 = 0 then 0 else span end as length_us"))


def _urls(spark, sf):
    args = spark.read.parquet(f"{sf}/region.parquet").selectExpr(
        "cast(r_regionkey as bigint) as line", "concat('https://media.example.org/', lower(r_name)) as url")
    part = F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"))
    lines = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.lit(1).alias("src"), part.alias("part"), F.col("page_id").alias("line"),
        F.expr("case when page_id % 11 = 10 then '   ' when page_id % 7 = 6 then concat('# ', url) "
               "else concat('  ', url, ' ') end").alias("url"))
    return mf.manifest(mf.arguments(args, "line", part), lines)


MANIFEST = URL_LINES + """, kept as (
  select 0 as src, cast(r_regionkey as bigint) as line, 'https://media.example.org/' || lower(r_name) as url from region
  union all select 1, page_id, trim(line) from lines where trim(line) <> '' and trim(line) not like '#%'),
manifest as (select row_number() over (order by src, line) as pos, url from kept)"""


@query(f"with {MANIFEST} select pos, url, printf('sheet_%02d', pos) as title from manifest")
def manifest(spark, sf):
    return _urls(spark, sf)


@query("""with v as (select p_brand || '/' || p_name as url, cast(p_partkey % 40 as varchar) as id,
    case when p_type = 'PROMO' then 'avc1' else lower(p_type) end as codec, p_size * 40 as height, p_partkey from part),
  t as (select *, case when codec like 'avc%' and height <= 1080 then 1 when height <= 1080 then 2
                       when id = '22' then 3 when id = '18' then 4 else 5 end as tier from v)
select url, id, codec, height, tier, p_partkey from t
qualify row_number() over (partition by url order by tier, height desc, id, p_partkey) = 1""")
def best_variant(spark, sf):
    v = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "concat(p_brand, '/', p_name) as url", "cast(p_partkey % 40 as string) as id",
        "case when p_type = 'PROMO' then 'avc1' else lower(p_type) end as codec", "p_size * 40 as height",
        "p_partkey")
    return jobs.best_variant(v, "url", "p_partkey")


@query("""with f as (select regexp_extract(url, '^https?://([^/]+)', 1) as folder,
    case page_id % 5 when 0 then 'video_' || page_id || '.mp4' when 1 then 'video_' || page_id || '.part'
      when 2 then 'thumb_' || page_id || '.webm' when 3 then 'video_' || page_id || '.mkv'
      else 'video_' || page_id || '.webm' end as name from pages)
select folder, min(name) filter (name like 'video%' and (name like '%.mp4' or name like '%.mkv' or name like '%.webm')) as output,
  case when count(*) filter (name like 'video%' and (name like '%.mp4' or name like '%.mkv' or name like '%.webm')) = 0
       then 'missing' else 'ok' end as status
from f group by folder""")
def pick_output(spark, sf):
    f = spark.read.parquet(f"{sf}/pages.parquet").selectExpr(
        "regexp_extract(url, '^https?://([^/]+)', 1) as folder",
        "case page_id % 5 when 0 then concat('video_', page_id, '.mp4') when 1 then concat('video_', page_id, '.part') "
        "when 2 then concat('thumb_', page_id, '.webm') when 3 then concat('video_', page_id, '.mkv') "
        "else concat('video_', page_id, '.webm') end as name")
    return jobs.pick_output(f, "folder", "name")


@query("""select event_id, case when event_type = 'purchase' then 'capture' else 'log' end as route,
  case when event_type = 'purchase' then '/out/frame_' || event_id || '.jpg' else event_type || ' ' || props end as payload
from events""")
def route_log(spark, sf):
    lines = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "case when event_type = 'purchase' then concat('FRAME_SAVED:/out/frame_', event_id, '.jpg') "
        "else concat(event_type, ' ', props) end as line")
    return lines.select("event_id", tx.route_line(F.col("line")).alias("r")).select("event_id", "r.*")


# ---- sampling

_FPS = "cast(user_id % 4 as double) * 25"


@query(f"""with {SIGNAL}, s as (select *, cast(greatest(1, floor((case when user_id % 4 > 0 then (user_id % 4) * 25.0::double
    else 20.0::double end) / 20 + 0.5::double)) as bigint) as k from signal)
select user_id, event_id, n, k, n // k as sample_idx from s where n % k = 0 and event_id % 13 <> 5""")
def sample_every(spark, sf):
    s = sampling.sample_every(sg.signal(spark, sf), F.expr(_FPS), F.expr("event_id % 13 <> 5"))
    return s.select("user_id", "event_id", "n", "k", "sample_idx")


@query(f"""with {SIGNAL}, s as (select *, cast(greatest(1, floor((user_id % 4) * 5.5::double / 2)) as bigint) as step from signal)
select user_id, event_id, n, step from s where n % step = 0 or n = total - 1""")
def sample_keep_last(spark, sf):
    fps = F.expr("cast(user_id % 4 as double) * 5.5D")
    return sampling.sample_keep_last(sg.signal(spark, sf), fps, LEGACY_FPS).select("user_id", "event_id", "n", "step")


@query(f"""with {SIGNAL} select user_id, event_id, rel_us from signal
where rel_us >= 432000 * 1000000::bigint and rel_us <= 1123200 * 1000000::bigint""")
def time_slice(spark, sf):
    s = sampling.with_span(sg.events(spark, sf), sg.KEY, "us", sg.day())
    return sampling.time_slice(s, "rel_us", 432_000, 1_123_200).select("user_id", "event_id", "rel_us")


_POS = (*PROBE_POSITIONS, PREVIEW_POSITION)


@query(f"""with {SIGNAL}, p as (select unnest([{', '.join(f'{p}::double' for p in _POS)}]) as p),
t as (select s.*, p, cast(floor(span_us * p) as bigint) as target,
             greatest(0, cast(floor(least(total - 1, total * p)) as bigint)) as idx from signal s, p)
select user_id, p, min_by(event_id, n) filter (rel_us >= target) as by_time,
       min(event_id) filter (n = idx) as by_index
from t group by user_id, p""")
def frame_at(spark, sf):
    s = sampling.with_span(sg.signal(spark, sf), sg.KEY, "us", sg.day())
    return sampling.frame_at(s, "user_id", "event_id", _POS)


@query(f"""with {SIGNAL}, r as (select *,
    sum(cast(floor(value) as bigint)) over w as canvas_w, sum(case when event_type = 'purchase' then 1 else 0 end) over w as scroll_cnt,
    sum(case when event_type = 'signup' then 1 else 0 end) over w as page_cnt,
    sum(case when event_type not in ('purchase', 'signup') then 1 else 0 end) over w as static_cnt
  from signal window w as (partition by user_id order by n))
select user_id, event_id, n, cast(canvas_w as bigint) as canvas_w, cast(scroll_cnt as bigint) as scroll_cnt,
  cast(page_cnt as bigint) as page_cnt, cast(static_cnt as bigint) as static_cnt, cast(floor(value) as bigint) as last_dx,
  case when span_us > 0 then rel_us / span_us * 100::double else 0 end as pct
from r where n > 0 and n % 16 = 0""")
def progress(spark, sf):
    s = sampling.with_span(sg.signal(spark, sf, "value", "event_type"), sg.KEY, "us", sg.day())
    sums = {"canvas_w": F.expr("cast(floor(value) as bigint)"),
            "scroll_cnt": F.expr("cast(event_type = 'purchase' as int)"),
            "page_cnt": F.expr("cast(event_type = 'signup' as int)"),
            "static_cnt": F.expr("cast(event_type not in ('purchase', 'signup') as int)")}
    # the legacy rate of 2 samples a second, so one snapshot per 16 samples
    p = sampling.progress(s, sg.KEY, sg.ORDER, sg.day(), sums, scan_fps=LEGACY_FPS)
    return p.select("user_id", "event_id", "n", *sums, F.floor("value").alias("last_dx"), "pct")


@query(f"""with {SIGNAL} select user_id, event_id, n, n / total * 100::double as pct from signal
where n > 0 and n % cast(floor((0.5::double + user_id % 3) * 10) as bigint) = 0""")
def progress_legacy(spark, sf):
    fps = F.expr("0.5D + user_id % 3")
    return sampling.progress_by_frames(sg.signal(spark, sf), fps).select("user_id", "event_id", "n", "pct")


@query(f"""with {SIGNAL}, b as (select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over
    (partition by user_id order by n rows between unbounded preceding and 1 preceding), 0) as before,
    (user_id % 5) * 8 as target from signal)
select user_id, event_id, n, cast(before as bigint) as blocks_before from b
where target <= 0 or before * 4 < target""")
def target_stop(spark, sf):
    s = sampling.target_stop(sg.signal(spark, sf, "event_type"), sg.KEY, sg.ORDER, sg.day(),
                             F.col("event_type") == "purchase", MEASURES_PER_BLOCK, F.expr("(user_id % 5) * 8"))
    return s.select("user_id", "event_id", "n", "blocks_before")


def stopped_in_waves(spark, sf, report=None, target="(user_id % 5) * 8"):
    """Waves of ten days over the stored events."""
    path = fresh_path(spark, "waves")
    s = sg.signal(spark, sf, "event_type")
    waves.write_waves(s, path, sg.KEY, F.expr(f"us div (10 * {DAY_US})"))
    return waves.target_stop_waves(spark, path, sg.events(spark, sf), sg.KEY, sg.ORDER, sg.day(), F.col("event_type") == "purchase", MEASURES_PER_BLOCK,
                                   F.expr(target), report)


@query(ORACLE["target_stop"])
def target_stop_waves(spark, sf):
    return stopped_in_waves(spark, sf).select("user_id", "event_id", "n", "blocks_before")


# ---- geometry

_ROI = ("case when event_id % 13 = 0 then concat('0.', lpad(event_id % 100, 2, '0'), ', 0.9,0.1') "
        "when event_id % 13 = 1 then concat('0.', lpad(event_id % 100, 2, '0'), ',x,0.1,0.9') "
        "else concat('0.', lpad(event_id % 100, 2, '0'), ', 0.', lpad((event_id + 37) % 100, 2, '0'), ',0.', "
        "lpad((event_id + 11) % 100, 2, '0'), ' ,0.', lpad((event_id + 59) % 100, 2, '0')) end")
_P2 = "lpad(cast((event_id + {}) % 100 as varchar), 2, '0')"
ROI = f"""roi as (select event_id, event_id % 13 >= 2 as ok,
    case when event_id % 13 >= 2 then cast('0.' || {_P2.format(0)} as double) else 0.70::double end as top,
    case when event_id % 13 >= 2 then cast('0.' || {_P2.format(37)} as double) else 1.00::double end as bottom,
    case when event_id % 13 >= 2 then cast('0.' || {_P2.format(11)} as double) else 0.00::double end as left_,
    case when event_id % 13 >= 2 then cast('0.' || {_P2.format(59)} as double) else 1.00::double end as right_,
    cast(320 + event_id % 1600 as int) as iw, cast(180 + event_id % 900 as int) as ih from events)"""


def _roi(spark, sf):
    return (spark.read.parquet(f"{sf}/events.parquet").select("event_id")
            .select("event_id", g.parse_roi(F.expr(_ROI)).alias("r"),
                    F.expr("cast(320 + event_id % 1600 as int)").alias("iw"),
                    F.expr("cast(180 + event_id % 900 as int)").alias("ih")))


def _c(*names):
    return [F.col(n) for n in names]


@query(f"""with {ROI} select event_id, top, bottom, left_ as "left", right_ as "right", ok from roi""")
def roi_parse(spark, sf):
    return _roi(spark, sf).select("event_id", "r.*")


RECT = f"""{ROI}, e as (select *, least(greatest(cast(trunc(ih * top) as int), 0), ih - 1) as y1,
    least(greatest(cast(trunc(iw * left_) as int), 0), iw - 1) as x1 from roi),
  rect as (select *, greatest(y1 + 1, least(ih, cast(trunc(ih * bottom) as int))) as y2,
    greatest(x1 + 1, least(iw, cast(trunc(iw * right_) as int))) as x2 from e)"""


@query(f"with {RECT} select event_id, iw, ih, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h from rect")
def roi_rect(spark, sf):
    rect = g.roi_rect(*_c("iw", "ih", "r.top", "r.bottom", "r.left", "r.right"))
    return _roi(spark, sf).select("event_id", "iw", "ih", rect.alias("q")).select("event_id", "iw", "ih", "q.*")


@query(f"""with {RECT} select event_id, y1 / ih::double as top, y2 / ih::double as bottom,
  x1 / iw::double as "left", x2 / iw::double as "right" from rect""")
def roi_ratio(spark, sf):
    rect = g.roi_rect(*_c("iw", "ih", "r.top", "r.bottom", "r.left", "r.right"))
    boxed = _roi(spark, sf).select("event_id", "iw", "ih", rect.alias("q"))
    return boxed.select("event_id", g.roi_ratio(*_c("q.x", "q.y", "q.w", "q.h", "iw", "ih")).alias("t")).select(
        "event_id", "t.*")


@query(f"""with {ROI}, b as (select event_id, iw, ih, cast(trunc(left_ * iw) as int) - 30 as bx, cast(trunc(top * ih) as int) - 30 as byy,
    greatest(20, cast(trunc((right_ - left_) * iw) as int)) as bw, greatest(20, cast(trunc((bottom - top) * ih) as int)) as bh from roi),
  p as (select *, greatest(0, least(iw - 1, bx)) as x, greatest(0, least(ih - 1, byy)) as y from b)
select event_id, x, y, greatest(1, least(iw - x, bw)) as w, greatest(1, least(ih - y, bh)) as h from p""")
def box_clamp(spark, sf):
    # the editable box, dragged 30 pixels up and left, cut back to the image
    box = g.initial_box(*_c("r.top", "r.bottom", "r.left", "r.right", "iw", "ih"))
    moved = _roi(spark, sf).select("event_id", "iw", "ih", box.alias("b"))
    cut = g.clamp_box(F.col("b.x") - 30, F.col("b.y") - 30, *_c("b.w", "b.h", "iw", "ih"))
    return moved.select("event_id", cut.alias("q")).select("event_id", "q.*")


@query(f"""with {ROI} select event_id, 'top ' || cast(floor(top * 100 + 0.5) as int) || '%-bottom ' ||
  cast(floor(bottom * 100 + 0.5) as int) || '%, left ' || cast(floor(left_ * 100 + 0.5) as int) || '%-right ' ||
  cast(floor(right_ * 100 + 0.5) as int) || '%' as label from roi""")
def roi_label(spark, sf):
    return _roi(spark, sf).select("event_id", g.roi_label(*_c("r.top", "r.bottom", "r.left", "r.right")).alias("label"))


@query("""with w as (select event_id, cast(16 + event_id % 1905 as int) as w from events),
 t as (select *, greatest(8, least(w - 1, cast(trunc(w * 0.15::double) as int))) as tw from w),
 i as (select *, greatest(tw, least(greatest(tw, w - 2 * tw), cast(trunc(w * 0.30::double) as int))) as inset2 from t)
select event_id, w, tw, inset2, w - tw - inset2 as reach2 from i""")
def band_geometry(spark, sf):
    w = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(16 + event_id % 1905 as int) as w")
    return w.select("event_id", "w", g.band_geometry(F.col("w")).alias("g")).select("event_id", "w", "g.*")


@query("""with s as (select event_id, cast(1 + event_id % 3000 as int) as iw, cast(event_id % 180 as int) as ih from events)
select event_id, least(2000, greatest(10, cast(trunc(iw * (120.0::double / greatest(1, ih))) as int))) as w, 120 as h from s""")
def ocr_size(spark, sf):
    s = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "cast(1 + event_id % 3000 as int) as iw", "cast(event_id % 180 as int) as ih")
    size = g.text_size(F.col("iw"), F.col("ih"), TEXT_HEIGHT, TEXT_MIN_W, TEXT_MAX_W)
    return s.select("event_id", size.alias("s")).select("event_id", "s.*")


# ---- jobs and names

RESULTS = """results as (select url, case when page_id % 9 = 4 then 'download failed' end as error,
  case when page_id % 9 <> 4 then length(html) // 4000 end as n_chunks from pages)"""


@query(f"""with {MANIFEST}, {RESULTS}
select case when error is not null then 'failed' when coalesce(n_chunks, 0) = 0 then 'empty' else 'ok' end as status,
  count(*) as n_items, cast(coalesce(sum(n_chunks), 0) as bigint) as n_chunks
from manifest left join results using (url) group by 1""")
def job_summary(spark, sf):
    results = spark.read.parquet(f"{sf}/pages.parquet").selectExpr(
        "url", "case when page_id % 9 = 4 then 'download failed' end as error",
        "case when page_id % 9 <> 4 then length(html) div 4000 end as n_chunks")
    return jobs.job_summary(_urls(spark, sf), results)


@query(f"with {MANIFEST} select pos, url from manifest where url not in (select url from pages where page_id % 3 = 0)")
def pending_urls(spark, sf):
    # the ledger of earlier runs: every third page
    ledger = spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 3 = 0")
    return jobs.pending(_urls(spark, sf), ledger).select("pos", "url")


@query("""select doc_id, substr(trim(regexp_replace(text, '[^a-zA-Z0-9가-힣_\\- ]', '', 'g')), 1, 50) as title from documents""")
def safe_title(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", tx.safe_title(F.col("text")).alias("title"))


_NAME = "case page_id % 4 when 0 then {u} || '.PDF' when 1 then {u} || ' . .' when 2 then ' ..' else {u} end"


@query(f"""with f as (select page_id, {_NAME.format(u='url')} as raw from pages),
b as (select page_id, regexp_replace(raw, '(?i)\\.pdf$', '') as base from f),
c as (select page_id, base, trim(regexp_replace(regexp_replace(base, '[\\\\/:*?"<>|\\x00-\\x1F]', '_', 'g'), '[ .]+$', '')) as clean from b)
select page_id, case when clean <> '' then clean || '.pdf' end as name, clean <> base as changed, clean <> '' as ok from c""")
def safe_filename(spark, sf):
    raw = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", f"{_NAME.format(u='url')} as raw")
    return raw.select("page_id", tx.safe_filename(F.col("raw")).alias("f")).select("page_id", "f.*")


@query("""with m as (select event_id, event_id * 4177 - 20000 as ms from events),
s as (select event_id, ms, greatest(0, ms) // 1000 as s from m)
select event_id, ms, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
  else printf('%02d:%02d', s // 60, s % 60) end as label from s""")
def fmt_duration(spark, sf):
    m = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "event_id * 4177 - 20000 as ms")
    return m.select("event_id", "ms", tx.duration_text(F.col("ms")).alias("label"))


@query("""select doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '\\b([1-9][0-9]{0,3})\\b', 1),
  lambda n: cast(n as int))), -1) as highest from documents""")
def highest_number(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", tx.highest_number(F.col("text")).alias("highest"))


@query("""with f as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as i,
  count(*) over (partition by o_custkey) as total from orders)
select o_custkey, i, total, i / total * 100::double as pct, i % 5 = 0 as callback, i % 20 = 0 as logged
from f where i % 5 = 0 or i % 20 = 0""")
def layout_progress(spark, sf):
    from panoloom.operators.layout import layout_progress as op
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey")
    return op(orders, "o_custkey", "o_orderkey").select("o_custkey", "i", "total", "pct", "callback", "logged")
