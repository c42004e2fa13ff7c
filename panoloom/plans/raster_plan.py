"""Queries for image kernels, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panoloom.functions import geometry as g
from panoloom.operators import ink as ik
from panoloom.operators import planes as pl
from panoloom.operators import raster as ra
from panoloom.operators import sampling
from panoloom.plans.common import BGR, FRAMES, INK, PANO, PX, STRIP, registry
from panoloom.settings import BLANK_FRACTION, POLARITY_TEXT, UNIFORM_STDDEV
from panoloom.sources import camera as cam

QUERIES, ORACLE, query = registry()

FRAME = "video_id, frame_idx"


def _slide(src, dst, fn, axis, before, after, keys=FRAME):
    other = "y" if axis == "x" else "x"
    return (f"{dst} as (select {keys}, y, x, {fn}(v) over (partition by {keys}, {other} order by {axis} "
            f"rows between {before} preceding and {after} following) as v from {src})")


def _rank(src, dst, fn, k, keys=FRAME):
    r = k // 2
    return ", ".join([_slide(src, f"{dst}_r", fn, "x", r, r, keys), _slide(f"{dst}_r", dst, fn, "y", r, r, keys)])


def _polarity(src, dst, level):
    return f"""{dst} as materialized (select {FRAME}, y, x, case when sum(v) over (partition by {FRAME}) <
      count(*) over (partition by {FRAME}) * {level} then 255 - v else v end as v from {src})"""


def _otsu(src, dst):
    return f"""{dst}_h as (select {FRAME}, v, count(*) as c from {src} group by {FRAME}, v),
{dst}_c as (select {FRAME}, v, sum(c) over w as n1, sum(c * v) over w as s1, sum(c) over (partition by {FRAME}) as n,
   sum(c * v) over (partition by {FRAME}) as s from {dst}_h window w as (partition by {FRAME} order by v)),
{dst}_v as (select {FRAME}, v, case when n1 = n then 0 else cast(n1 * s - n * s1 as double) * cast(n1 * s - n * s1 as double)
   / (cast(n1 as double) * cast(n - n1 as double)) end as spread from {dst}_c),
{dst} as (select {FRAME}, case when spread > 0 then v else 0 end as t from {dst}_v
   qualify row_number() over (partition by {FRAME} order by spread desc, v) = 1)"""


def _hlines(src, dst):
    return f"""{dst}_i as (select {FRAME}, y, x, x - row_number() over (partition by {FRAME}, y order by x) as run from {src}),
{dst} as (select {FRAME}, y, x from {dst}_i qualify count(*) over (partition by {FRAME}, y, run) < 21)"""


_W31 = ra.gaussian_weights(31)


def _adaptive(src, dst, keys=FRAME, last_x="63", last_y="15"):
    """31 by 31 neighbourhood by two joins against the weights."""
    on = " and ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    area = sum(_W31) ** 2
    return f"""kern as (select unnest([{', '.join(map(str, _W31))}]) as w, unnest(range(-15, 16)) as d),
{dst}_x as materialized (select {pk}, p.y, p.x, p.v, cast(sum(q.v * k.w) as bigint) as h from {src} p, kern k, {src} q
   where {on} and q.y = p.y and q.x = least({last_x}, greatest(0, p.x + k.d)) group by all),
{dst}_y as (select {pk}, p.y, p.x, p.v, cast(sum(q.h * k.w) as bigint) as s from {dst}_x p, kern k, {dst}_x q
   where {on} and q.x = p.x and q.y = least({last_y}, greatest(0, p.y + k.d)) group by all),
{dst} as (select {keys}, y, x, case when v <= (2 * s + {area}::bigint) // {2 * area}::bigint - 12 then 255 else 0 end as v from {dst}_y)"""


@query(f"with {FRAMES} select * from frames")
def frames_scan(spark, sf):
    return cam.frames(spark, sf)


@query(f"with {PX} select {FRAME}, y - 4 as y, x - 8 as x, v from px where y between 4 and 11 and x between 8 and 55")
def crop(spark, sf):
    rect = g.roi_rect(F.lit(cam.W), F.lit(cam.H), F.lit(0.25), F.lit(0.75), F.lit(0.125), F.lit(0.875))
    return ra.crop(cam.px(spark, sf), rect)


@query(f"""with {FRAMES}, r as (select {FRAME}, cast(off % 80 - 8 as int) as rx, cast(frame_idx % 4 as int) as ry,
  cast(10 + frame_idx % 50 as int) as rw, cast(12 + frame_idx % 3 as int) as rh from frames),
k as (select *, rx >= 0 and rx + rw <= 64 and ry + rh <= 16 as ok from r)
select {FRAME}, case when ok then rx else 0 end as x, case when ok then ry else 0 end as y,
  case when ok then rw else 64 end as w, case when ok then rh else 16 end as h from k""")
def crop_safe(spark, sf):
    f = cam.frames(spark, sf).select(*cam.FRAME, *[F.expr(e).cast("int").alias(n) for n, e in (
        ("rx", "off % 80 - 8"), ("ry", "frame_idx % 4"), ("rw", "10 + frame_idx % 50"), ("rh", "12 + frame_idx % 3"))])
    rect = g.safe_rect(F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"), F.lit(cam.W), F.lit(cam.H))
    return f.select(*cam.FRAME, rect.alias("r")).select(*cam.FRAME, "r.*")


@query(f"with {BGR} select {FRAME}, y, x, v from gray")
def luma(spark, sf):
    return ra.luma(cam.bgr(spark, sf))


@query(f"""with {PX}, lit as materialized (select {FRAME}, y, x, least(255, v + 60 * cast(frame_idx % 2 as int)) as v from px),
{_polarity('lit', 'pol', 128)} select * from pol""")
def auto_polarity(spark, sf):
    # every other frame brighter, so that some stay as they are
    px = cam.px(spark, sf).withColumn("v", F.expr("least(255, v + 60 * cast(frame_idx % 2 as int))"))
    return ra.auto_polarity(px, POLARITY_TEXT)


@query(f"with {PX}, {_rank('px', 'd', 'max', 9)} select * from d")
def dilate9(spark, sf):
    return ra.dilate(cam.px(spark, sf), 9)


@query(f"with {PX}, {_rank('px', 'd', 'min', 9)} select * from d")
def erode9(spark, sf):
    return ra.erode(cam.px(spark, sf), 9)


@query(f"with {PX}, {_rank('px', 'e', 'min', 3)}, {_rank('e', 'o', 'max', 3)} select * from o")
def open3(spark, sf):
    return ra.opening(cam.px(spark, sf), 3)


def _blackhat(src, dst, keys=FRAME):
    on = ", ".join(keys.split(", ") + ["y", "x"])
    return (f"{_rank(src, dst + '_d', 'max', 9, keys)}, {_rank(dst + '_d', dst + '_e', 'min', 9, keys)}, "
            f"{dst} as materialized (select {keys}, y, x, c.v - p.v as v from {dst}_e c join {src} p using ({on}))")


@query(f"with {PX}, {_blackhat('px', 'bh')} select * from bh")
def blackhat(spark, sf):
    return ra.blackhat(cam.px(spark, sf))


@query(f"with {PX}, {_otsu('px', 'th')} select {FRAME}, y, x, t from px join th using ({FRAME}) where v > t")
def otsu(spark, sf):
    return ra.otsu_join(cam.px(spark, sf)).where("v > t").drop("v")


@query(f"with {PX}, {_adaptive('px', 'ad')} select {FRAME}, y, x from ad where v > 0")
def adaptive_ink(spark, sf):
    return ra.adaptive_ink(cam.px(spark, sf))


@query(f"with {PX} select {FRAME}, y, x from px where v > 200")
def fixed_ink(spark, sf):
    return ra.fixed_ink(cam.px(spark, sf))


_LINE = "y = frame_idx % 16 and x between frame_idx % 20 and frame_idx % 20 + 19 + frame_idx % 3"


@query(f"""with {FRAMES}, lined as (select {FRAME}, y, x from cells
  where e < -0.1::double or x = (5 * frame_idx) % 64 or ({_LINE})), {_hlines('lined', 'kept')} select * from kept""")
def drop_hlines(spark, sf):
    # each frame gets one run of 20, 21 or 22 pixels; runs of 21 and more are lines at this width
    lined = cam.marks(spark, sf).where(f"`on` or ({_LINE})").drop("on")
    return ra.drop_hlines(lined, cam.W)


@query(f"""with {PX}, b as (select {FRAME}, y, x, case when v > 100 then 255 else 0 end as v from px),
{_rank('b', 'e', 'min', 3)}, {_rank('e', 'o', 'max', 3)} select {FRAME}, y, x from o where v > 0""")
def legacy_mask(spark, sf):
    # a level that leaves blocks of 3 by 3 on noise
    return ra.legacy_mask(cam.px(spark, sf), 100)


@query(f"with {PX}, {_slide('px', 'a', 'min', 'x', 1, 0)}, {_slide('a', 'b', 'min', 'y', 1, 0)} select * from b")
def thicken2(spark, sf):
    return ra.thicken(cam.px(spark, sf))


@query(f"with {PX} select {FRAME}, y, x, least(255, v * 3) as v from px")
def gain(spark, sf):
    return ra.gain(cam.px(spark, sf))


@query(f"with {PX} select {FRAME}, y, x, case when v > 45 then v else 0 end as v from px")
def noise_floor(spark, sf):
    return ra.noise_floor(cam.px(spark, sf))


@query(f"""with {PX}, third as (select * from px where x < 21), o as (select unnest(range(3)) as d)
select {FRAME}, cast(y * 3 + a.d as int) as y, cast(x * 3 + b.d as int) as x, v from third, o a, o b""")
def upsample3(spark, sf):
    return ra.upsample(cam.px(spark, sf).where(F.col("x") < cam.W // 3))


@query(f"""with {PX}, s as (select {FRAME}, count(*) as n, cast(sum(v) as bigint) as sum_v, cast(sum(v * v) as bigint) as sum_v2 from px group by {FRAME})
select *, sum_v / n as mean, sqrt(cast(n * sum_v2 - sum_v * sum_v as double)) / n as stddev from s""")
def frame_stats(spark, sf):
    return ra.frame_stats(cam.px(spark, sf))


@query(f"""with {PX}, pairs as (select {FRAME}, lag(frame_idx) over (partition by video_id order by frame_idx) as prev_frame_idx from frames)
select p.video_id, p.frame_idx, prev_frame_idx, count(*) filter (abs(a.v - b.v) > 20) as n_changed, cast(count(*) as int) as n_px,
  count(*) filter (abs(a.v - b.v) > 20) / count(*) as ratio
from pairs p join px a on a.video_id = p.video_id and a.frame_idx = p.frame_idx
join px b on b.video_id = p.video_id and b.frame_idx = prev_frame_idx and b.y = a.y and b.x = a.x group by all""")
def change_ratio(spark, sf):
    return ik.change_ratio(cam.px(spark, sf))


_BLANKED = "frame_idx < 3 or frame_idx % 17 = 9"
_RATIO = f"""shown as (select * from ink where not ({_BLANKED})),
ratios as (select f.video_id, f.frame_idx, count(s.x) as n_ink, count(s.x) / 1024 as ratio
  from frames f left join shown s on s.video_id = f.video_id and s.frame_idx = f.frame_idx group by all)"""


@query(f"with {INK}, {_RATIO} select * from ratios")
def content_ratio(spark, sf):
    shown = cam.ink(spark, sf).where(f"not ({_BLANKED})")
    return ik.content_ratio(cam.frames(spark, sf), shown, cam.W * cam.H)


@query(f"""with {INK}, {_RATIO}, f as (select video_id, min(frame_idx) as first from ratios where ratio >= 0.004::double group by 1)
select video_id, frame_idx, n_ink, ratio from ratios join f using (video_id) where frame_idx >= first""")
def intro_skip(spark, sf):
    return sampling.intro_skip(content_ratio(spark, sf), "video_id", "frame_idx", F.col("ratio"), ik.frame_segment())


FEATURE_TRANSLUCENT = (f"{_polarity('gray', 'pol', 100)}, {_blackhat('pol', 'bh')}, {_otsu('bh', 'th')}, "
                       f"fbin as (select {FRAME}, y, x from bh join th using ({FRAME}) where v > t), {_hlines('fbin', 'feat')}")


@query(f"with {BGR}, {FEATURE_TRANSLUCENT} select * from feat")
def feature_translucent(spark, sf):
    return ra.feature_translucent(cam.bgr(spark, sf), cam.W)


FEATURE_OPAQUE = (f"{_polarity('gray', 'pol', 110)}, {_adaptive('pol', 'ad')}, "
                  f"fbin as (select {FRAME}, y, x from ad where v > 0), {_hlines('fbin', 'feat')}")


@query(f"with {BGR}, {FEATURE_OPAQUE} select * from feat")
def feature_opaque(spark, sf):
    return ra.feature_opaque(cam.bgr(spark, sf), cam.W)


@query(f"with {BGR}, {FEATURE_TRANSLUCENT} select * from feat")
def feature_translucent_planes(spark, sf):
    return ik.unpack(pl.features(cam.planes(spark, sf)), cam.H)


@query(f"with {BGR}, {FEATURE_OPAQUE} select * from feat")
def feature_opaque_planes(spark, sf):
    return ik.unpack(pl.features(cam.planes(spark, sf), opaque=True), cam.H)


# flat frames, frames with four dark pixels, and the others as they are
_MIXED = """case when frame_idx % 5 = 1 then 200 when frame_idx % 5 = 2 then (case when y = 3 and x between 10 and 13 then 0 else 255 end) else v end"""


@query(f"""with {PX}, mixed as materialized (select {FRAME}, y, x, {_MIXED} as v from px), {_polarity('mixed', 'pol', 128)}, {_otsu('pol', 'th')},
s as (select {FRAME}, count(*) as n, sum(v) as s1, sum(v * v) as s2 from mixed group by {FRAME}),
c as (select {FRAME}, count(*) filter (v <= t) as n_dark from pol join th using ({FRAME}) group by {FRAME})
select {FRAME}, n_dark, case when sqrt(cast(n * s2 - s1 * s1 as double)) / n < 8 then 'uniform'
  when n_dark / n < 0.005::double then 'blank' else 'ok' end as reason from s join c using ({FRAME})""")
def readable_gate(spark, sf):
    return ra.readable_gate(cam.px(spark, sf).withColumn("v", F.expr(_MIXED)), POLARITY_TEXT, UNIFORM_STDDEV, BLANK_FRACTION)


# ---- panorama

_AROUND = "around as (select dy, dx from (select unnest(range(-1, 2)) as dy), (select unnest(range(-1, 2)) as dx))"


def _despeckle(src, dst):
    """Six rounds of label spreading over marks ``src`` (video_id, y, x, v > 0)."""
    sql = [_AROUND, f"sl0 as materialized (select video_id, y, x, y * 1099511627776::bigint + x as lab from {src} where v > 0)"]
    near = """(select l.*, y + dy as ny, x + dx as nx from {a} l, around) a join {a} b
          on b.video_id = a.video_id and b.y = a.ny and b.x = a.nx group by all)"""
    for i in range(1, 7):
        sql.append(f"sl{i} as materialized (select a.video_id, a.y, a.x, min(b.lab) as lab from {near.format(a=f'sl{i - 1}')}")
    sql.append(f"sl7 as materialized (select a.video_id, a.y, a.x, a.lab, min(b.lab) as lo, max(b.lab) as hi from {near.format(a='sl6')}")
    sql.append(f"""{dst}_g as (select video_id, y, x, count(*) over (partition by video_id, lab) as n,
       max(case when hi <> lo then 1 else 0 end) over (partition by video_id, lab) as open from sl7),
    {dst} as (select video_id, y, x from {dst}_g where n >= 8 or open = 1)""")
    return ", ".join(sql)


@query(f"""with {STRIP}, m as (select video_id, y, sx as x, case when e < -0.1::double then 255 else 0 end as v from strip),
{_despeckle('m', 'kept')} select * from kept""")
def despeckle(spark, sf):
    m = cam.strip(spark, sf).selectExpr("video_id", "y", "sx as x", "case when e < -0.1D then 255 else 0 end as v")
    return ra.own_columns(ra.despeckle(ra.tiled(m, 8), keys=ra.TILE)).where("v > 0").drop("v")


def _pano_pol(level):
    return f"""pol as materialized (select video_id, y, x, case when sum(v) over (partition by video_id) <
  count(*) over (partition by video_id) * {level} then 255 - v else v end as v,
  max(x) over (partition by video_id) as mx, max(y) over (partition by video_id) as my from pano)"""


CLAHE = """cp as materialized (select *, (mx + 8) // 8 as tw, (my + 8) // 8 as th, y // ((my + 8) // 8) as ty, x // ((mx + 8) // 8) as tx from pol),
ct as (select video_id, ty, tx, count(*) as n, greatest(1, count(*) * 2 // 256) as cl from cp group by all),
ch as (select t.video_id, t.ty, t.tx, n, cl, l.v, coalesce(c, 0) as c from ct t cross join (select unnest(range(256)) as v) l
  left join (select video_id, ty, tx, v, count(*) as c from cp group by all) h on h.video_id = t.video_id and h.ty = t.ty and h.tx = t.tx and h.v = l.v),
ce as (select *, cast(sum(greatest(c - cl, 0)) over (partition by video_id, ty, tx) as bigint) as over_ from ch),
cd as (select video_id, ty, tx, v, n, cast(sum(least(c, cl) + over_ // 256 + case when v < over_ % 256 then 1 else 0 end)
   over (partition by video_id, ty, tx order by v) as bigint) as cdf from ce),
lut as materialized (select video_id, ty, tx, v, (510 * cdf + n) // (2 * n) as o from cd),
cm as (select video_id, max(ty) as ymax, max(tx) as xmax from ct group by 1),
cw as (select cp.*, cast(floor((2 * x - tw) / (2.0::double * tw)) as bigint) as cx, cast(floor((2 * y - th) / (2.0::double * th)) as bigint) as cy,
  xmax, ymax from cp join cm using (video_id)),
cr as (select *, 2 * x - tw - cx * 2 * tw as rx, 2 * y - th - cy * 2 * th as ry, least(greatest(cx, 0), xmax) as x1,
  least(greatest(cx + 1, 0), xmax) as x2, least(greatest(cy, 0), ymax) as y1, least(greatest(cy + 1, 0), ymax) as y2 from cw),
eq as materialized (select r.video_id, r.y, r.x, cast((2 * ((a.o * (2 * tw - rx) + b.o * rx) * (2 * th - ry) + (c.o * (2 * tw - rx) + d.o * rx) * ry)
   + 4 * tw * th) // (8 * tw * th) as int) as v from cr r
  join lut a on a.video_id = r.video_id and a.ty = y1 and a.tx = x1 and a.v = r.v
  join lut b on b.video_id = r.video_id and b.ty = y1 and b.tx = x2 and b.v = r.v
  join lut c on c.video_id = r.video_id and c.ty = y2 and c.tx = x1 and c.v = r.v
  join lut d on d.video_id = r.video_id and d.ty = y2 and d.tx = x2 and d.v = r.v)"""


@query(f"with {PANO}, {_pano_pol(0)}, {CLAHE} select * from eq")
def clahe(spark, sf):
    return ra.clahe(cam.pano(spark, sf))


FLOORED = """floored as materialized (select video_id, y, x, case when least(255, v * 3) > 45 then least(255, v * 3) else 0 end as v from bh)"""


def _paper(src):
    return f"""select p.video_id, p.y, p.x, case when k.x is null then 255 else 255 - p.v end as b,
  case when k.x is null then 255 else 255 - p.v end as g, case when k.x is null then 255 else 255 - p.v end as r
from {src} p left join kept k on k.video_id = p.video_id and k.y = p.y and k.x = p.x"""


@query(f"""with {PANO}, {_pano_pol(100)}, {CLAHE}, {_blackhat('eq', 'bh', 'video_id')}, {FLOORED},
{_despeckle('floored', 'kept')} {_paper('floored')}""")
def clean_translucent(spark, sf):
    return ra.clean_translucent(cam.pano(spark, sf))


@query(f"""with {PANO}, {_pano_pol(110)}, {_adaptive('pol', 'ad', 'video_id, mx, my', 'p.mx', 'p.my')},
m as materialized (select video_id, y, x, v from ad), {_despeckle('m', 'kept')} {_paper('m')}""")
def clean_opaque(spark, sf):
    return ra.clean_opaque(cam.pano(spark, sf))
