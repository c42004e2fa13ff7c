"""Queries for frame matching, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panoloom.operators import ink as ik
from panoloom.operators import match as ma
from panoloom.plans.common import INK, STRIP, registry
from panoloom.sources import camera as cam

QUERIES, ORACLE, query = registry()
BAND = ma.Band(cam.W, cam.H)        # tw 9, second inset 19, reach 36


def phi_sql(n: int) -> str:
    return (f"case when nt * ({n} - nt) = 0 then 1.0::double when np * ({n} - np) = 0 then 0.0::double else "
            f"cast({n} * n11 - nt * np as double) / sqrt(cast(nt * ({n} - nt) as double) * cast(np * ({n} - np) as double)) end")


PAIRS = """pairs as materialized (select video_id, frame_idx, prev_frame_idx from (select video_id, frame_idx,
  lag(frame_idx) over (partition by video_id order by frame_idx) as prev_frame_idx from frames) where prev_frame_idx is not null)"""


def scores_sql(dst: str, pairs: str, inset: int, ink: str = "ink", tpl="frame_idx", ref="prev_frame_idx", tw: int = 9) -> str:
    """(pair, dx, score) by joining ink of equal rows and counting shifts."""
    return f"""{dst}_t as (select p.video_id, p.frame_idx, p.prev_frame_idx, i.y, i.x - {inset} as tx
     from {pairs} p join {ink} i on i.video_id = p.video_id and i.frame_idx = p.{tpl} where i.x >= {inset} and i.x < {inset + tw}),
  {dst}_nt as (select video_id, frame_idx, prev_frame_idx, count(*) as nt from {dst}_t group by all),
  {dst}_n11 as (select t.video_id, t.frame_idx, t.prev_frame_idx, r.x - t.tx as loc, count(*) as n11
     from {dst}_t t join {ink} r on r.video_id = t.video_id and r.frame_idx = t.{ref} and r.y = t.y
     where r.x - t.tx between 0 and {64 - tw} group by all),
  {dst}_np as (select video_id, frame_idx, loc, count(*) as np from {ink}, (select unnest(range({65 - tw})) as loc)
     where x >= loc and x < loc + {tw} group by all),
  {dst} as materialized (select p.video_id, p.frame_idx, p.prev_frame_idx, l.loc - {inset} as dx,
     {phi_sql(tw * 16).replace('nt', 'coalesce(t.nt, 0)').replace('np', 'coalesce(w.np, 0)').replace('n11', 'coalesce(n.n11, 0)')} as score
   from {pairs} p cross join (select unnest(range({65 - tw})) as loc) l
   left join {dst}_nt t on t.video_id = p.video_id and t.frame_idx = p.frame_idx and t.prev_frame_idx = p.prev_frame_idx
   left join {dst}_n11 n on n.video_id = p.video_id and n.frame_idx = p.frame_idx and n.prev_frame_idx = p.prev_frame_idx and n.loc = l.loc
   left join {dst}_np w on w.video_id = p.video_id and w.frame_idx = p.{ref} and w.loc = l.loc)"""


def peak_sql(dst: str, scores: str) -> str:
    return f"""{dst} as materialized (select video_id, frame_idx, prev_frame_idx, cast(arg as int) as dx, peak, zero from (
    select video_id, frame_idx, prev_frame_idx, first(dx order by score desc, dx) as arg, max(score) as peak,
      max(score) filter (dx = 0) as zero from {scores} group by all))"""


GATE = "dx >= 4 and dx <= 55 and peak >= 0.40::double and peak - zero >= 0.15::double"
CONSENSUS = f"""cons as (select m.video_id, m.frame_idx, m.prev_frame_idx, m.dx, m.peak, m.zero,
   case when {GATE.replace('dx', 'm.dx').replace('peak', 'm.peak').replace('zero', 'm.zero')} and m.dx <= 36 then m2.dx end as dx2,
   {GATE.replace('dx', 'm.dx').replace('peak', 'm.peak').replace('zero', 'm.zero')} as base, m2.peak as peak2
   from m join m2 using (video_id, frame_idx, prev_frame_idx)),
 voted as (select *, coalesce(dx2 is not null and peak2 >= 0.40::double and abs(dx - dx2) > 6, false) as vetoed from cons)
select video_id, frame_idx, prev_frame_idx, dx, dx2, vetoed, base and not vetoed as accepted from voted"""
BOTH = f"{scores_sql('s', 'pairs', 0)}, {peak_sql('m', 's')}, {scores_sql('s2', 'pairs', 19)}, {peak_sql('m2', 's2')}"


def pairs(spark, sf):
    return ma.consecutive(ik.pack(cam.marks(spark, sf), cam.H))


@query(f"with {INK}, {PAIRS}, {scores_sql('s', 'pairs', 0)} select video_id, frame_idx, prev_frame_idx, cast(dx as int) as dx, score from s")
def match_scores(spark, sf):
    return ma.match_scores(pairs(spark, sf), BAND)


@query(f"with {INK}, {PAIRS}, {scores_sql('s', 'pairs', 0)}, {peak_sql('m', 's')} select * from m")
def match_peak(spark, sf):
    return ma.match_peak(pairs(spark, sf), BAND).select(*cam.FRAME, "prev_frame_idx", "m.*")


@query(f"with {INK}, {PAIRS}, {scores_sql('s', 'pairs', 0)}, {peak_sql('m', 's')} select *, {GATE} as scrolled from m")
def scroll_gate(spark, sf):
    m = ma.match_peak(pairs(spark, sf), BAND)
    return m.withColumn("scrolled", ma.scroll_gate(F.col("m"), BAND)).select(*cam.FRAME, "prev_frame_idx", "m.*", "scrolled")


def _consensus(p):
    return ma.consensus(p, BAND).select(*cam.FRAME, "prev_frame_idx", "m.dx", F.col("m2.dx").alias("dx2"), "vetoed", "accepted")


@query(f"with {INK}, {PAIRS}, {BOTH}, {CONSENSUS}")
def consensus(spark, sf):
    return _consensus(pairs(spark, sf))


# Two halves shifted by different amounts: of every 90 columns (the last block ends with the strip) one frame shows columns
# 0..63 and the next shows 10..23 followed by 40..., so the two bands report 10 and 26 and the second one vetoes.
SPLICE = STRIP + """, dims as (select video_id, max(sx) + 1 as width from strip group by 1),
base as (select video_id, b, least(b * 90, width - 90) as s0 from (select video_id, width, unnest(range(0, (width + 89) // 90)) as b from dims where width >= 90)),
splice as (select video_id, b * 2 as frame_idx, sx - s0 as fx, y, e from base join strip using (video_id) where sx - s0 between 0 and 63
  union all select video_id, b * 2 + 1, sx - s0 - 10, y, e from base join strip using (video_id) where sx - s0 between 10 and 23
  union all select video_id, b * 2 + 1, sx - s0 - 26, y, e from base join strip using (video_id) where sx - s0 between 40 and 89),
ink as materialized (select video_id, frame_idx, y, cast(fx as int) as x from splice where e < -0.1::double),
pairs as materialized (select video_id, b * 2 + 1 as frame_idx, b * 2 as prev_frame_idx from base)"""


@query(f"with {SPLICE}, {BOTH}, {CONSENSUS}")
def consensus_splice(spark, sf):
    s = cam.strip(spark, sf).where("width >= 90").withColumn("b", F.explode(F.expr(
        "array_distinct(array(sx div 90, (width - 1) div 90))"))).withColumn("c", F.expr("sx - least(b * 90, width - 90)")).where("c between 0 and 89")
    views = ("filter(array(named_struct('f', b * 2, 'x', c, 'ok', c < 64), named_struct('f', b * 2 + 1, 'x', c - 10, 'ok', c between 10 and 23), "
             "named_struct('f', b * 2 + 1, 'x', c - 26, 'ok', c between 40 and 89)), q -> q.ok)")
    marks = s.select("video_id", "y", "e", F.inline(F.expr(views))).selectExpr(
        "video_id", "f as frame_idx", "y", "cast(x as int) as x", "e < -0.1D as on")
    packed = ik.pack(marks, cam.H)
    p = ma.consecutive(packed).where("frame_idx % 2 = 1 and prev_frame_idx = frame_idx - 1")
    return _consensus(p)


@query(f"""with {INK}, {PAIRS}, {scores_sql('s', 'pairs', 40, tpl='prev_frame_idx', ref='frame_idx', tw=16)}, {peak_sql('m', 's')}
select video_id, frame_idx, prev_frame_idx, cast(case when peak > 0.7::double then dx + 40 + 24 else -1 end as int) as overlap_x from m""")
def overlap_x(spark, sf):
    return ma.overlap_x(pairs(spark, sf), BAND, 16, 8).select(*cam.FRAME, "prev_frame_idx", "overlap_x")


@query(f"""with {INK}, c as (select video_id, frame_idx, x, count(*) as n from ink group by all),
b as (select * from c where n / 16 > 0.7::double qualify row_number() over (partition by video_id, frame_idx order by n desc, x desc) = 1)
select f.video_id, f.frame_idx, coalesce(b.x, -1) as bar_x from frames f left join b using (video_id, frame_idx)""")
def bar_line(spark, sf):
    return ma.bar_line(ik.pack(cam.marks(spark, sf), cam.H), BAND).select(*cam.FRAME, "bar_x")


SIM = f"""band as (select * from ink where x < 9), bn as (select video_id, frame_idx, count(*) as c from band group by all),
common as (select p.video_id, p.frame_idx, count(*) as n11 from pairs p join band a on a.video_id = p.video_id and a.frame_idx = p.frame_idx
  join band b on b.video_id = p.video_id and b.frame_idx = p.prev_frame_idx and b.y = a.y and b.x = a.x group by all),
sims as (select p.*, {phi_sql(144)} as sim from (select p.video_id, p.frame_idx, p.prev_frame_idx, coalesce(a.c, 0) as nt, coalesce(b.c, 0) as np, coalesce(n11, 0) as n11
  from pairs p left join bn a on a.video_id = p.video_id and a.frame_idx = p.frame_idx
  left join bn b on b.video_id = p.video_id and b.frame_idx = p.prev_frame_idx
  left join common o on o.video_id = p.video_id and o.frame_idx = p.frame_idx) p)"""


@query(f"""with {INK}, {PAIRS}, {SIM} select video_id, frame_idx, prev_frame_idx, sim, sim < 0.62::double as changed, sim >= 0.90::double as stable from sims""")
def page_sim(spark, sf):
    return ma.page_sim(pairs(spark, sf), BAND).select(*cam.FRAME, "prev_frame_idx", "sim", "changed", "stable")
