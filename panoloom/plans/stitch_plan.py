"""Queries from decisions to chunks and pages, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panoloom.operators import fold as fo
from panoloom.operators import jobs
from panoloom.operators import layout as la
from panoloom.operators import stitch as st
from panoloom.plans.common import PANO, PX, registry
from panoloom.plans.fold_plan import PAGE_STEPS, SCROLL_FOLD, packed
from panoloom.plans.match_plan import BAND
from panoloom.session import settle
from panoloom.sources import camera as cam

QUERIES, ORACLE, query = registry()

# odd videos flip pages, even ones scroll
_MIXED = f"""{SCROLL_FOLD}, {PAGE_STEPS.replace('fold', 'pfold')},
log as (select * from fold where video_id % 2 = 0 union all select * from pfold where video_id % 2 = 1)"""

_STRIPS = """seeds as (select video_id, max(frame_idx) as frame_idx, 64 as width from log where action in ('seed', 'refresh') group by 1),
parts as (select * from seeds union all select video_id, frame_idx, strip_w from log where action in ('scroll', 'page')),
strips as materialized (select video_id, row_number() over w - 1 as strip_no, frame_idx, cast(64 - width as int) as src_x, cast(width as int) as width,
  cast(coalesce(sum(width) over (partition by video_id order by frame_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as canvas_x
  from parts window w as (partition by video_id order by frame_idx))"""

_PIXELS = "px as" + PX.split("px as")[1]
_STITCHED = """stitched as materialized (select p.video_id, p.y, canvas_x + p.x - src_x as x, p.v from px p join strips s
  on s.video_id = p.video_id and s.frame_idx = p.frame_idx where p.x >= src_x)"""


def _chunks_sql(src):
    return f"""spans as (select video_id, x // 64 as chunk_no, max(x) + 1 as x1 from {src} group by all),
chunks as (select video_id, chunk_no, printf('frame_%04d.jpg', chunk_no) as name, chunk_no * 64 as x0, cast(x1 - chunk_no * 64 as int) as w,
  cast(64 - (x1 - chunk_no * 64) as int) as pad from spans where x1 - chunk_no * 64 >= 40)"""


PADDED = """padded as (
  select c.video_id, c.chunk_no, p.y, cast(p.x - x0 as int) as x, p.v from chunks c join {src} p on p.video_id = c.video_id and p.x >= x0 and p.x < x0 + w
  union all select c.video_id, c.chunk_no, cast(y as int), cast(x as int), 255 from chunks c, unnest(range(16)) as t(y), unnest(range(64)) as q(x) where x >= w)
select * from padded"""


def decisions(spark, sf):
    """Decision log with each video in its own mode, stored because several operators read it."""
    mode = jobs.sheet_mode(F.expr("case when video_id % 2 = 1 then 'opaque' end"))
    frames = packed(spark, sf).withColumn("mode", mode)
    scroll = fo.scroll_fold(frames.where("mode = 'TRANSLUCENT'"), BAND)
    return settle(scroll.unionByName(fo.page_fold(frames.where("mode = 'OPAQUE'"), BAND)))


def _strips(spark, sf):
    return st.canvas_offsets(decisions(spark, sf), cam.W)


@query(f"with recursive {_MIXED}, {_STRIPS} select * from strips")
def canvas_offsets(spark, sf):
    return _strips(spark, sf)


@query(f"""with recursive {_MIXED}, {_STRIPS}, {_PIXELS} select s.video_id, strip_no, p.y, p.x - src_x as x, p.v from px p join strips s
  on s.video_id = p.video_id and s.frame_idx = p.frame_idx where p.x >= src_x""")
def strips(spark, sf):
    s = st.strip_pixels(_strips(spark, sf), cam.px(spark, sf))
    return s.select("video_id", "strip_no", "y", (F.col("x") - F.col("src_x")).alias("x"), "v")


@query(f"with recursive {_MIXED}, {_STRIPS}, {_PIXELS}, {_STITCHED} select * from stitched")
def panorama(spark, sf):
    return st.panorama(_strips(spark, sf), cam.px(spark, sf))


@query(f"with recursive {_MIXED}, {_STRIPS}, {_PIXELS}, {_STITCHED}, {_chunks_sql('stitched')} select * from chunks")
def stitch_chunks(spark, sf):
    return st.chunks(_strips(spark, sf), cam.W)


@query(f"with recursive {_MIXED}, {_STRIPS}, {_PIXELS}, {_STITCHED}, {_chunks_sql('stitched')}, {PADDED.format(src='stitched')}")
def slice_padded(spark, sf):
    return st.chunk_pixels(st.panorama(_strips(spark, sf), cam.px(spark, sf)), cam.W)


@query(f"with {PANO}, {_chunks_sql('pano')} select * from chunks")
def chunk_names(spark, sf):
    return st.pano_chunks(cam.pano(spark, sf), cam.W)


@query(f"with {PANO}, {_chunks_sql('pano')} select video_id, chunk_no, x0, w, pad from chunks")
def slice(spark, sf):
    whole = cam.vectors(spark, sf).selectExpr("video_id", "vpos as frame_idx", "vpos * 4 as canvas_x", "4 as width")
    return st.chunks(whole, cam.W).drop("name")


# ---- pages

def _layout_sql(doc, items):
    """Layout of ``items(doc, n, img_w, img_h)`` by recursion over images."""
    return f"""sized as materialized (select {doc}, n, img_h * ((595.28::double - 2 * 20.0::double) / img_w) as h from {items}),
lay as (select {doc}, cast(-1 as bigint) as n, 1 as page_no, 0 as nslot, 841.89::double - 20.0::double as pen, 0::double as y, 0::double as h, 0 as slot
    from sized group by {doc}
  union all select {doc}, n, page_no + brk, (case when brk = 1 then 0 else nslot end) + 1, pen2 - (h + 25.0::double), pen2 - h, h,
    case when brk = 1 then 0 else nslot end from (
      select *, case when brk = 1 then 841.89::double - 20.0::double else pen end as pen2 from (
        select l.{doc}, s.n, l.page_no, l.nslot, l.pen, s.h, case when l.pen - s.h < 20.0::double then 1 else 0 end as brk
        from lay l join sized s on s.{doc} = l.{doc} and s.n = l.n + 1))),
pages_out as (select {doc}, n, cast(page_no as bigint) as page_no, slot, 20.0::double as x, y, 595.28::double - 2 * 20.0::double as w, h from lay where n >= 0)"""


@query(f"""with recursive items as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n,
  600 as img_w, cast(50 + o_orderkey % 400 as int) as img_h from orders), {_layout_sql('o_custkey', 'items')} select * from pages_out""")
def page_layout(spark, sf):
    items = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_custkey", "o_orderkey", "600 as img_w", "cast(50 + o_orderkey % 400 as int) as img_h")
    return la.page_layout(items, "o_custkey", "o_orderkey", "img_w", "img_h", segment_rows=8)


@query(f"""with recursive items as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n,
  600 as img_w, cast(50 + o_orderkey % 400 as int) as img_h from orders), {_layout_sql('o_custkey', 'items')} select * from pages_out""")
def page_layout_pointers(spark, sf):
    items = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_custkey", "o_orderkey", "600 as img_w", "cast(50 + o_orderkey % 400 as int) as img_h")
    return la.page_layout_pointers(items, "o_custkey", "o_orderkey", "img_w", "img_h", segment_rows=8)


@query(f"""with recursive {_MIXED}, {_STRIPS}, {_PIXELS}, {_STITCHED}, {_chunks_sql('stitched')},
items as (select video_id, row_number() over (partition by video_id order by chunk_no) - 1 as n, 64 as img_w, 16 as img_h from chunks),
{_layout_sql('video_id', 'items')} select * from pages_out""")
def stitch_layout(spark, sf):
    c = stitch_chunks(spark, sf).withColumn("img_w", F.lit(cam.W)).withColumn("img_h", F.lit(cam.H))
    return la.page_layout(c, "video_id", "chunk_no", "img_w", "img_h")
