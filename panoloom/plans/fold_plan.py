"""Queries for order-dependent decisions, each with the same query in SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import functions as F

from panoloom.operators import fold as fo
from panoloom.operators import ink as ik
from panoloom.operators import match as ma
from panoloom.operators import pointers as po
from panoloom.operators import sampling
from panoloom.plans.common import INK, STRIP, registry
from panoloom.plans.jobs_plan import SIGNAL
from panoloom.plans.match_plan import BAND, PAIRS, peak_sql, phi_sql, scores_sql
from panoloom.settings import FLUSH_MIN
from panoloom.sources import camera as cam
from panoloom.sources import signal as sg

QUERIES, ORACLE, query = registry()

# every ordered pair of frames of a video, then one row per frame from the recursion
ALL_PAIRS = """pairs as materialized (select a.video_id, b.frame_idx, a.frame_idx as prev_frame_idx
  from frames a join frames b on b.video_id = a.video_id and b.frame_idx > a.frame_idx)"""

SIMS = f"""nums as materialized (select f.video_id, f.frame_idx, count(i.x) as c from frames f
   left join ink i on i.video_id = f.video_id and i.frame_idx = f.frame_idx and i.x < 9 group by all),
 same as (select a.video_id, b.frame_idx, a.frame_idx as prev_frame_idx, count(*) as n11 from ink a join ink b
   on b.video_id = a.video_id and b.frame_idx > a.frame_idx and b.y = a.y and b.x = a.x where a.x < 9 group by all),
 sims as materialized (select q.video_id, q.frame_idx, q.prev_frame_idx, {phi_sql(144)} as sim from (
   select p.*, t.c as nt, r.c as np, coalesce(n11, 0) as n11 from pairs p
   join nums t on t.video_id = p.video_id and t.frame_idx = p.frame_idx
   join nums r on r.video_id = p.video_id and r.frame_idx = p.prev_frame_idx
   left join same s on s.video_id = p.video_id and s.frame_idx = p.frame_idx and s.prev_frame_idx = p.prev_frame_idx) q)"""

_NEXT = "nxt as materialized (select video_id, frame_idx, lead(frame_idx) over (partition by video_id order by frame_idx) as nf from frames)"

_SEED = """select video_id, min(frame_idx) as frame_idx, min(frame_idx) as com, false as scrolled, 'seed' as action,
   null::int as dx, null::double as peak, null::double as zero, 64 as strip_w, false as vetoed from frames group by video_id"""

# every frame of the camera tables has content, so the first one is the seed
SCROLL_STEPS = f"""{ALL_PAIRS}, {scores_sql('s', 'pairs', 0)}, {peak_sql('m', 's')}, {scores_sql('s2', 'pairs', 19)}, {peak_sql('m2', 's2')},
{SIMS}, {_NEXT},
ev as materialized (select m.*, base and m.dx <= 36 and m2.peak >= 0.40::double and abs(m.dx - m2.dx) > 6 as vetoed, sims.sim as near
  from (select *, dx >= 4 and dx <= 55 and peak >= 0.40::double and peak - zero >= 0.15::double as base from m) m
  join m2 using (video_id, frame_idx, prev_frame_idx) left join sims using (video_id, frame_idx, prev_frame_idx)),
fold as ({_SEED} union all
  select d.video_id, d.frame_idx, case when d.action in ('scroll', 'page', 'refresh') then d.frame_idx else d.com end,
    d.scrolled or d.action in ('scroll', 'page'), d.action, d.dx, d.peak, d.zero,
    case d.action when 'scroll' then d.dx when 'page' then 64 else 0 end, d.vetoed
  from (select f.video_id, n.nf as frame_idx, f.com, f.scrolled, e.dx, e.peak, e.zero, e.vetoed,
     case when e.base and not e.vetoed then 'scroll' when not f.scrolled and e.zero >= 0.70::double then 'refresh'
          when e.peak < 0.30::double then case when l.near >= 0.75::double then 'page' else 'hold' end else 'static' end as action
   from fold f join nxt n on n.video_id = f.video_id and n.frame_idx = f.frame_idx
   join ev e on e.video_id = f.video_id and e.frame_idx = n.nf and e.prev_frame_idx = f.com
   join ev l on l.video_id = f.video_id and l.frame_idx = n.nf and l.prev_frame_idx = f.frame_idx) d)"""

SCROLL_FOLD = f"{INK}, {SCROLL_STEPS}"

PAGE_STEPS = f"""fold as ({_SEED} union all
  select d.video_id, d.frame_idx, case when d.action in ('page', 'refresh') then d.frame_idx else d.com end,
    d.scrolled or d.action = 'page', d.action, 0, d.peak, d.zero, case d.action when 'page' then 64 else 0 end, false
  from (select f.video_id, n.nf as frame_idx, f.com, f.scrolled, e.sim as peak, l.sim as zero,
     case when e.sim < 0.62::double and l.sim >= 0.90::double then 'page'
          when not f.scrolled and e.sim >= 0.62::double then 'refresh' else 'static' end as action
   from fold f join nxt n on n.video_id = f.video_id and n.frame_idx = f.frame_idx
   join sims e on e.video_id = f.video_id and e.frame_idx = n.nf and e.prev_frame_idx = f.com
   join sims l on l.video_id = f.video_id and l.frame_idx = n.nf and l.prev_frame_idx = f.frame_idx) d)"""
PAGE_FOLD = f"{INK}, {ALL_PAIRS}, {SIMS}, {_NEXT}, {PAGE_STEPS}"

# segments of eight rows, so that these small tables need several rounds of the folds' fixpoint
SHORT = "frame_idx div 8"

LOG = "select video_id, frame_idx, action, dx, peak, zero, strip_w, vetoed from fold"


def packed(spark, sf):
    return ik.pack(cam.marks(spark, sf), cam.H)


@query(f"with recursive {SCROLL_FOLD} {LOG}")
def scroll_fold(spark, sf):
    return fo.scroll_fold(packed(spark, sf), BAND, F.expr(SHORT))


@query(f"with recursive {PAGE_FOLD} {LOG}")
def page_fold(spark, sf):
    return fo.page_fold(packed(spark, sf), BAND, F.expr(SHORT))


@query(f"with recursive {PAGE_FOLD} {LOG}")
def page_fold_pointers(spark, sf):
    return po.page_fold_pointers(packed(spark, sf), BAND, 8)


@query(f"""with recursive {SCROLL_FOLD} select video_id, count(*) filter (action = 'scroll') as scrolls, count(*) filter (action = 'page') as pages,
  count(*) filter (action in ('static', 'hold', 'refresh')) as statics, count(*) filter (vetoed) as rejects, cast(sum(strip_w) as bigint) as canvas_w
from fold group by video_id""")
def fold_summary(spark, sf):
    return fo.fold_summary(scroll_fold(spark, sf))


@query(f"""with recursive {SIGNAL},
fold as (select user_id, n, value as saved, value as prev, 0 as run, false as fired from signal where n = 0 union all
  select user_id, n, case when fired then value else saved end, value, run, fired from (
   select *, run >= 2 as fired from (
    select s.user_id, s.n, s.value, f.saved, case when abs(s.value - f.saved) / greatest(abs(f.saved), 1.0::double) < 0.3::double then 0
       when abs(s.value - f.prev) / greatest(abs(f.prev), 1.0::double) < 0.6::double then (case when f.fired then 0 else f.run end) + 1 else 0 end as run
    from fold f join signal s on s.user_id = f.user_id and s.n = f.n + 1)))
select user_id, n, run, fired from fold""")
def debounce(spark, sf):
    # thresholds for the wide scatter of the signal: away from the saved value by 30 %, within 60 % of the one before
    s = sg.signal(spark, sf, "value").withColumn("seg", F.expr("n div 8"))
    return fo.debounce(s, "user_id", "n", "value", 0.3, 0.6)


def barred(spark, sf):
    return ma.bar_line(ik.pack(cam.barred_marks(spark, sf), cam.H), BAND)


# steadily moving frames with bars; every pair's difference and overlap, then the recursion
MEASURE_FOLD = STRIP + f""", dims as (select video_id, max(sx) + 1 as width from strip group by video_id),
ks as (select video_id, width, unnest(range(0, (width // 28 + 1) * 3)) as frame_idx from dims),
frames as (select video_id, frame_idx, least(28 * (frame_idx // 3), width - 64) as off from ks where greatest(0, 28 * ((frame_idx - 1) // 3)) + 64 <= width),
ink as materialized (select f.video_id, f.frame_idx, s.y, cast(s.sx - f.off as int) as x from frames f join strip s
   on s.video_id = f.video_id and s.sx >= f.off and s.sx < f.off + 64 where s.e < -0.1::double or s.sx % 28 = 6),
{ALL_PAIRS}, {scores_sql('s', 'pairs', 40, tpl='prev_frame_idx', ref='frame_idx', tw=16)}, {peak_sql('m', 's')},
size as (select video_id, frame_idx, count(*) as c from ink group by all),
same as (select a.video_id, b.frame_idx, a.frame_idx as prev_frame_idx, count(*) as n11 from ink a join ink b
   on b.video_id = a.video_id and b.frame_idx > a.frame_idx and b.y = a.y and b.x = a.x group by all),
ev as materialized (select m.video_id, m.frame_idx, m.prev_frame_idx, case when peak > 0.7::double then dx + 64 else -1 end as overlap,
   (t.c + r.c - 2 * coalesce(n11, 0)) / 1024 as diff from m
   join size t on t.video_id = m.video_id and t.frame_idx = m.frame_idx join size r on r.video_id = m.video_id and r.frame_idx = m.prev_frame_idx
   left join same s on s.video_id = m.video_id and s.frame_idx = m.frame_idx and s.prev_frame_idx = m.prev_frame_idx),
tall as (select video_id, frame_idx, x, count(*) as n from ink group by all),
bars as (select video_id, frame_idx, x from tall where n / 16 > 0.7::double
   qualify row_number() over (partition by video_id, frame_idx order by n desc, x desc) = 1), {_NEXT},
fold as (select video_id, min(frame_idx) as frame_idx, min(frame_idx) as saved, 0 as run, null::double as changed, null::double as moved,
   false as fired, false as captured, null::int as x0, null::int as x1 from frames group by video_id
 union all select video_id, nf, case when captured then nf else saved end, case when captured then 0 else run end, changed, moved, run >= 2, captured,
   case when captured then overlap end, case when captured then bar end from (
   select *, run >= 2 and bar <> -1 and overlap <> -1 and bar - overlap > 64 * 0.4::double as captured from (
    select f.video_id, n.nf, f.saved, c.diff as changed, p.diff as moved, cast(c.overlap as int) as overlap, coalesce(b.x, -1) as bar,
      case when c.diff >= 0.02::double and p.diff < 0.015::double then f.run + 1 else 0 end as run
    from fold f join nxt n on n.video_id = f.video_id and n.frame_idx = f.frame_idx
    join ev c on c.video_id = f.video_id and c.frame_idx = n.nf and c.prev_frame_idx = f.saved
    join ev p on p.video_id = f.video_id and p.frame_idx = n.nf and p.prev_frame_idx = f.frame_idx
    left join bars b on b.video_id = f.video_id and b.frame_idx = n.nf)))"""


@query(f"with recursive {MEASURE_FOLD} select video_id, frame_idx, changed, moved, fired, captured, x0, x1 from fold")
def measure_fold(spark, sf):
    return fo.measure_fold(barred(spark, sf), BAND, 16, 8, F.expr(SHORT))


@query(f"""with {INK}, {PAIRS}, {scores_sql('s', 'pairs', 40, tpl='prev_frame_idx', ref='frame_idx', tw=16)}, {peak_sql('m', 's')},
r as (select video_id, frame_idx, case when peak > 0.7::double then cast(dx + 64 as int) else 0 end as x0 from m
   qualify row_number() over (partition by video_id order by frame_idx desc) = 1)
select video_id, frame_idx, x0, 64 - x0 as width from r where 64 - x0 > 50""")
def flush_tail(spark, sf):
    # what the last frame shows beyond its overlap with the frame before
    found = ma.overlap_x(ma.consecutive(packed(spark, sf)), BAND, 16, 8).select("video_id", "frame_idx", "overlap_x")
    last = sampling.last_rows(found, "video_id", "frame_idx")
    return sampling.flush_tail(last, F.col("overlap_x"), cam.W, FLUSH_MIN).select("video_id", "frame_idx", "x0", "width")
