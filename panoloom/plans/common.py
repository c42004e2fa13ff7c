"""Registration and the SQL that derives the frame tables, shared by the query modules."""

from __future__ import annotations


def registry():
    """(queries, oracle, decorator) of one module."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if sql:
                oracle[fn.__name__] = sql
            return fn
        return register
    return queries, oracle, query


STRIP = """v as (select label % 5 as video_id, row_number() over (partition by label % 5 order by vec_id) - 1 as vpos, embedding from embeddings),
u as (select video_id, vpos, unnest(embedding) as e, unnest(range(64)) as i from v),
strip as (select cast(video_id as bigint) as video_id, vpos * 4 + i % 4 as sx, cast(i // 4 as int) as y, cast(e as double) as e from u)"""

PANO = STRIP + """,
pano as (select video_id, y, sx as x, cast(greatest(0, least(255, floor((e + 0.55::double) * 230))) as int) as v from strip)"""

FRAMES = STRIP + """,
dims as (select video_id, max(sx) + 1 as width from strip group by video_id),
ks as (select video_id, width, unnest(range(0, (width // 104 + 1) * 12)) as k from dims),
raws as (select *, 104 * (k // 12) + case when k % 12 < 3 then 0 when k % 12 < 6 then 12 when k % 12 < 9 then 42 else 104 end as raw from ks),
offs as (select *, least(raw, width - 64) as off, coalesce(lag(raw) over (partition by video_id order by k), 0) as before from raws),
frames as (select video_id, k as frame_idx, off, k * 50000 as ts_us, 20::double as fps from offs where before + 64 <= width),
cells as (select f.video_id, f.frame_idx, s.y, cast(s.sx - f.off as int) as x, s.e
          from frames f join strip s on s.video_id = f.video_id and s.sx >= f.off and s.sx < f.off + 64)"""

INK = FRAMES + """,
ink as materialized (select video_id, frame_idx, y, x from cells where e < -0.1::double or x = (5 * frame_idx) % 64)"""

PX = FRAMES + """,
px as materialized (select video_id, frame_idx, y, x, case when x = (5 * frame_idx) % 64 then 20
       else cast(greatest(0, least(255, floor((e + 0.55::double) * 230))) as int) end as v from cells)"""

BGR = PX + """,
bgr as (select video_id, frame_idx, y, x, v as b, (v * 7 + 13) % 256 as g, (v * 3 + 101) % 256 as r from px),
gray as materialized (select video_id, frame_idx, y, x, (299 * r + 587 * g + 114 * b + 500) // 1000 as v from bgr)"""
