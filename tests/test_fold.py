"""Folds against plain sequential loops, and their invariances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panoloom.operators import fold as fo
from panoloom.operators import ink as ik
from panoloom.operators import layout as la
from panoloom.operators import match as ma
from panoloom.operators import pointers as po
from panoloom.plans.fold_plan import barred, packed
from panoloom.plans.match_plan import BAND
from panoloom.sources import camera as cam


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def frames(spark, small):
    return packed(spark, small).cache()


def phi(a, b):
    """Correlation of two boolean patches from its definition."""
    if a.std() == 0:
        return 1.0
    if b.std() == 0:
        return 0.0
    return float(np.corrcoef(a.ravel(), b.ravel())[0, 1])


def masks(spark, small):
    out = {}
    for r in cam.ink(spark, small).collect():
        out.setdefault(r.video_id, {}).setdefault(r.frame_idx, np.zeros((16, 64), bool))[r.y, r.x] = True
    return out


def loop(video, mode):
    """The rules read literally, one video at a time, on boolean images."""
    com = last = None
    moved, log = False, []
    for idx in sorted(video):
        cur = video[idx]
        if com is None:
            com = last = cur
            log.append((idx, "seed", 64))
            continue
        if mode == "scroll":
            s = [phi(cur[:, :9], com[:, i:i + 9]) for i in range(56)]
            dx = next(i for i, v in enumerate(s) if v >= max(s) - 1e-12)
            ok = 4 <= dx <= 55 and s[dx] >= 0.40 and s[dx] - s[0] >= 0.15
            if ok and dx <= 36:
                s2 = [phi(cur[:, 19:28], com[:, i:i + 9]) for i in range(56)]
                d2 = next(i for i, v in enumerate(s2) if v >= max(s2) - 1e-12) - 19
                ok = not (max(s2) >= 0.40 and abs(dx - d2) > 6)
            if ok:
                act, w = "scroll", dx
            elif not moved and s[0] >= 0.70:
                act, w = "refresh", 0
            elif max(s) < 0.30:
                act, w = ("page", 64) if phi(cur[:, :9], last[:, :9]) >= 0.75 else ("hold", 0)
            else:
                act, w = "static", 0
        else:
            same, still = phi(cur[:, :9], com[:, :9]), phi(cur[:, :9], last[:, :9])
            act, w = (("page", 64) if same < 0.62 and still >= 0.90
                      else ("refresh", 0) if not moved and same >= 0.62 else ("static", 0))
        if act in ("scroll", "page", "refresh"):
            com = cur
            moved = moved or act != "refresh"
        last = cur
        log.append((idx, act, w))
    return log


@pytest.mark.parametrize("mode", ["scroll", "page"])
def test_fold_equals_loop(spark, small, frames, mode):
    fold = fo.scroll_fold if mode == "scroll" else fo.page_fold
    got = rows(fold(frames, BAND).select("video_id", "frame_idx", "action", "strip_w"))
    want = sorted((v, *r) for v, video in masks(spark, small).items() for r in loop(video, mode))
    assert got == want


@pytest.mark.parametrize("fold", [fo.scroll_fold, fo.page_fold])
@pytest.mark.parametrize("length", [7])
def test_segment_length_changes_nothing(frames, fold, length):
    one = rows(fold(frames, BAND))
    assert rows(fold(frames.repartition(5), BAND, F.expr(f"frame_idx div {length}"))) == one


def test_counts(frames):
    # the counts of ``loop`` above on these frames
    def tally(log):
        return {r.action: r["count"] for r in log.groupBy("action").count().collect()}
    assert tally(fo.scroll_fold(frames, BAND)) == {"seed": 5, "refresh": 5, "scroll": 40, "page": 13, "hold": 13, "static": 127}
    assert tally(fo.page_fold(frames, BAND)) == {"seed": 5, "page": 45, "refresh": 6, "static": 147}


def test_accepted_shift_is_the_true_one(spark, small, frames):
    log = fo.scroll_fold(frames, BAND).join(cam.frames(spark, small), ["video_id", "frame_idx"])
    for video in range(5):
        com = None
        for r in log.where(F.col("video_id") == video).orderBy("frame_idx").collect():
            if r.action == "scroll":
                assert r.dx == r.off - com
            if r.action in ("seed", "refresh", "scroll", "page"):
                com = r.off


def test_blank_frames_before_the_seed_are_skipped(spark, frames):
    blank = F.when(F.col("frame_idx") < 3, F.expr("transform(cols, c -> 0L)")).otherwise(F.col("cols"))
    log = fo.scroll_fold(frames.withColumn("cols", blank), BAND, F.expr("frame_idx div 2"))
    head = log.where("frame_idx <= 3").select("frame_idx", "action").distinct().orderBy("frame_idx").collect()
    assert [tuple(r) for r in head] == [(0, "skip"), (1, "skip"), (2, "skip"), (3, "seed")]


def test_measure_fold_equals_loop(spark, small):
    b = barred(spark, small).cache()
    got = {(r.video_id, r.frame_idx): r for r in fo.measure_fold(b, BAND, 16, 8, F.expr("frame_idx div 10")).collect()}
    bar = {(r.video_id, r.frame_idx): r.bar_x for r in b.collect()}
    seen = {}
    for r in cam.barred_marks(spark, small).where("`on`").collect():
        seen.setdefault((r.video_id, r.frame_idx), np.zeros((16, 64), bool))[r.y, r.x] = True
    captures = 0
    for v in range(5):
        saved = prev = None
        run = 0
        for key in sorted(k for k in seen if k[0] == v):
            cur = seen[key]
            if saved is None:
                saved = prev = cur
                continue
            run = run + 1 if (saved ^ cur).mean() >= 0.02 and (prev ^ cur).mean() < 0.015 else 0
            x0 = -1
            if run >= 2 and bar[key] != -1:
                s = [phi(saved[:, 40:56], cur[:, i:i + 16]) for i in range(49)]
                x0 = int(np.argmax(s)) + 24 if max(s) > 0.7 else -1
            hit = x0 != -1 and bar[key] - x0 > 25.6
            assert (got[key].fired, got[key].captured) == (run >= 2, hit)
            if hit:
                assert (got[key].x0, got[key].x1) == (x0, bar[key])
                saved, run, captures = cur, 0, captures + 1
            prev = cur
    assert captures > 0


def test_layout_over_tall_first_image_leaves_page_one_blank(spark):
    items = spark.createDataFrame([(1, 0, 600, 900), (1, 1, 600, 100)], "doc long, i long, w int, h int")
    got = la.page_layout(items, "doc", "i", "w", "h").orderBy("n").collect()
    assert [(r.page_no, r.slot) for r in got] == [(2, 0), (3, 0)]


@pytest.mark.parametrize("length", [9, 1000])
def test_layout_segments_change_nothing(spark, small, length):
    items = spark.read.parquet(f"{small}/orders.parquet").selectExpr(
        "o_custkey % 3 as doc", "o_orderkey as i", "600 as w", "cast(50 + o_orderkey % 400 as int) as h").where("i < 120")
    want, pen, page, slot = {}, {}, {}, {}
    for r in items.orderBy("i").collect():
        d, h = r.doc, r.h * ((595.28 - 2 * 20.0) / r.w)
        pen.setdefault(d, 841.89 - 20.0)
        if pen[d] - h < 20.0:
            pen[d], page[d], slot[d] = 841.89 - 20.0, page.get(d, 1) + 1, 0
        n = sum(1 for k in want if k[0] == d)
        want[d, n] = (page.get(d, 1), slot.get(d, 0), pen[d] - h)
        slot[d] = slot.get(d, 0) + 1
        pen[d] -= h + 25.0
    got = {(r.doc, r.n): (r.page_no, r.slot, r.y) for r in la.page_layout(items, "doc", "i", "w", "h", length).collect()}
    assert got == want


def test_splice_is_vetoed(spark, small):
    from panoloom.plans import queries
    got = queries()["consensus_splice"](spark, small).collect()
    assert len(got) >= 5 and all((r.dx, r.dx2, r.vetoed, r.accepted) == (10, 26, True, False) for r in got)


def pair(spark, ref, cur):
    data = [(0, f, y, x, bool(m[y, x])) for f, m in ((0, ref), (1, cur)) for y in range(16) for x in range(64)]
    marks = spark.createDataFrame(data, "video_id long, frame_idx long, y int, x int, `on` boolean")
    return ma.consecutive(ik.pack(marks, 16))


def test_degenerate_and_tied_scores(spark):
    rng = np.random.default_rng(7)
    busy = rng.random((16, 64)) < 0.3
    flat = busy.copy()
    flat[:, :9] = False
    assert {r.score for r in ma.match_scores(pair(spark, busy, flat), BAND).collect()} == {1.0}   # flat template
    empty = np.zeros((16, 64), bool)
    assert {r.score for r in ma.match_scores(pair(spark, empty, busy), BAND).collect()} == {0.0}  # flat window
    tile = np.tile(rng.random((16, 8)) < 0.4, (1, 8))
    m = ma.match_peak(pair(spark, tile, np.roll(tile, -3, axis=1)), BAND).first().m
    assert (m.dx, m.peak) == (3, 1.0)                                                             # first of equal peaks


def test_tall_frames_use_several_words(spark):
    rng = np.random.default_rng(3)
    wide = rng.random((100, 80)) < 0.3
    data = [(0, f, y, x, bool(wide[y, x + off])) for f, off in ((0, 0), (1, 9)) for y in range(100) for x in range(64)]
    marks = spark.createDataFrame(data, "video_id long, frame_idx long, y int, x int, `on` boolean")
    band = ma.Band(64, 100)
    packed_ = ik.pack(marks, 100)
    assert ma.match_peak(ma.consecutive(packed_), band).first().m.dx == 9
    assert [r.dx for r in fo.scroll_fold(packed_, band).orderBy("frame_idx").collect()] == [None, 9]
    back = {(r.frame_idx, r.y, r.x) for r in ik.unpack(packed_, 100).collect()}
    assert back == {(f, y, x) for _, f, y, x, on in data if on}


def test_scores_of_a_wide_frame_and_of_nulls(spark):
    rng = np.random.default_rng(8)
    wide = rng.random((720, 1400)) < 0.2
    words = ik.words(720)
    def packed_row(off):
        tall = np.zeros((1280, words * 64), bool)
        tall[:, :720] = wide[:, off:off + 1280].T
        return np.packbits(tall, axis=1, bitorder="little").view("<i8").reshape(-1).tolist()
    df = spark.createDataFrame([(1, packed_row(40), packed_row(0)), (2, None, packed_row(0)), (3, packed_row(0), None)],
                               "video_id long, cols array<long>, prev_cols array<long>")
    band = ma.Band(1280, 720)
    got = {r.video_id: r for r in ma.match_peak(df, band).collect()}
    assert (got[1].m.dx, got[1].m.peak) == (40, 1.0)
    assert got[2].m.peak is None and got[3].m.peak is None


# ---- pointers

@pytest.mark.parametrize("block", [1, 8, 1000])
def test_page_pointers_equal_fold(frames, block):
    assert rows(po.page_fold_pointers(frames, BAND, block)) == rows(fo.page_fold(frames, BAND))


def test_page_pointers_skip_blank_frames(spark, frames):
    blank = F.transform("cols", lambda c: c * 0)
    some = frames.withColumn("cols", F.when((F.col("frame_idx") < 9) | (F.col("video_id") == 2), blank).otherwise(F.col("cols")))
    log = po.page_fold_pointers(some, BAND, 8)
    assert rows(log) == rows(fo.page_fold(some, BAND))
    assert {r.action for r in log.where("video_id = 2").collect()} == {"skip"}


def test_rounds_of_page_pointers_are_logarithmic(frames):
    commits, rounds = po.page_commits(po._bands(frames, BAND, 8), BAND)
    longest = max(r["count"] for r in commits.groupBy("video_id").count().collect())
    assert longest > 8 and rounds <= np.log2(longest) + 1


def test_walk_of_many_steps(spark):
    hops = spark.range(1000).selectExpr("id % 2 as k", "id as node", "id + 2 as to").where("to < 1000")
    found, rounds = po.reached(hops, spark.createDataFrame([(0, 0), (1, 501), (7, 5)], "k long, node long"), "k")
    assert rows(found) == sorted([(0, n) for n in range(0, 1000, 2)] + [(1, n) for n in range(501, 1000, 2)] + [(7, 5)])
    assert rounds == 9


@pytest.mark.parametrize("length", [8, 64])
def test_layout_by_page_starts_equals_fold(spark, length):
    items = spark.range(600).selectExpr("id % 3 as doc", "id as i", "600 as w", "cast(case when id % 3 = 2 then 1 else abs(hash(id)) % 900 end as int) as h")
    assert rows(la.page_layout_pointers(items, "doc", "i", "w", "h", length)) == rows(la.page_layout(items, "doc", "i", "w", "h", 50))
    sized = items.selectExpr("doc", "(row_number() over (partition by doc order by i)) - 1L as n", f"h * ({595.28 - 40.0}D / w) as h")
    starts, rounds = la.page_starts(sized, "doc", length)
    longest = max(r["count"] for r in starts.groupBy("doc").count().collect())
    assert longest > 30 and rounds <= np.log2(longest) + 1


def test_layout_by_page_starts_of_few_images(spark):
    items = spark.createDataFrame([(1, 0, 600, 900), (1, 1, 600, 100), (2, 5, 600, 10)], "doc long, i long, w int, h int")
    got = la.page_layout_pointers(items, "doc", "i", "w", "h").orderBy("doc", "n").collect()
    assert [(r.doc, r.page_no, r.slot) for r in got] == [(1, 2, 0), (1, 3, 0), (2, 1, 0)]
    assert la.page_layout_pointers(items.limit(0), "doc", "i", "w", "h").count() == 0
