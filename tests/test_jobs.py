"""Manifest files, geometry edges, sequences cut into segments, and late stream rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panoloom.functions import geometry as g
from panoloom.functions import text as tx
from panoloom.operators import segments as sg
from panoloom.operators import stitch as st
from panoloom.plans.fold_plan import packed
from panoloom.plans.match_plan import BAND
from panoloom.sources import manifest as mf
from panoloom.streaming import scroll
from panoloom.session import fresh_path
from panoloom.streaming.runner import drain


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first().c


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("# list\n  https://a/1 \n\n\t\nhttps://a/2\n   # no\nhttps://a/3\n")
    part = F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"))
    args = mf.arguments(spark.createDataFrame([("https://z/9", 0)], "url string, line long"), "line", part)
    got = mf.manifest(args, mf.read_lines(spark, str(path))).orderBy("pos").collect()
    assert [(r.pos, r.url, r.title) for r in got] == [
        (1, "https://z/9", "sheet_01"), (2, "https://a/1", "sheet_02"), (3, "https://a/2", "sheet_03"), (4, "https://a/3", "sheet_04")]


@pytest.mark.parametrize("text,ok", [("0.1, 0.9,0,1", True), ("0.1,0.9,0", False), ("a,0,0,1", False), ("0.1,0.9,0,1,,", True), ("", False)])
def test_roi(spark, text, ok):
    r = one(spark, g.parse_roi(F.lit(text)))
    assert r.ok == ok and (r.top, r.bottom, r.left, r.right) == ((0.1, 0.9, 0.0, 1.0) if ok else (0.7, 1.0, 0.0, 1.0))


def test_rect_is_never_empty(spark):
    r = one(spark, g.roi_rect(F.lit(100), F.lit(50), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.2)))
    assert tuple(r) == (99, 49, 1, 1)


@pytest.mark.parametrize("text,n", [("bar 12 of 345", 345), ("x12 0012 12345", -1), ("９ 7", 7), ("", -1), ("10000 9999", 9999)])
def test_highest_number(spark, text, n):
    assert one(spark, tx.highest_number(F.lit(text))) == n


@pytest.mark.parametrize("ms,text", [(-5, "00:00"), (59_999, "00:59"), (3_600_000, "1:00:00"), (3_599_999, "59:59")])
def test_duration(spark, ms, text):
    assert one(spark, tx.duration_text(F.lit(ms))) == text


def test_file_names(spark):
    assert tuple(one(spark, tx.safe_filename(F.lit("a:b?.PDF")))) == ("a_b_.pdf", True, True)
    assert tuple(one(spark, tx.safe_filename(F.lit(" . ")))) == (None, True, False)


def test_segments_equal_plain_windows(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id * 7 % 501 as o", "id % 11 as a")
    seg, w = F.expr("o div 40"), Window.partitionBy("k").orderBy("o")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    def rows(d):
        return sorted(tuple(r) for r in d.collect())
    assert rows(sg.number_rows(df, ["k"], ["o"], seg, total="t").select("k", "o", "n", "t")) == rows(
        df.select("k", "o", F.row_number().over(w) - 1, F.count("o").over(Window.partitionBy("k"))))
    assert rows(sg.running_sums(df, ["k"], ["o"], seg, {"s": F.col("a")}).select("k", "o", "s")) == rows(
        df.select("k", "o", F.sum("a").over(run)))
    assert sorted(map(str, rows(sg.previous(df, ["k"], ["o"], seg, ["a"]).select("k", "o", "prev_a").na.fill(-1)))) == sorted(map(str, rows(
        df.select("k", "o", F.lag("a").over(w).alias("p")).na.fill(-1))))


def test_narrow_panorama_gives_no_chunk(spark):
    strips = spark.createDataFrame([(0, 0, 0, 0, 32, 0)], "video_id long, strip_no long, frame_idx long, src_x int, width int, canvas_x long")
    assert st.chunks(strips, 32).count() == 0
    wide = spark.createDataFrame([(0, 0, 0, 0, 64, 0), (0, 1, 1, 24, 40, 64)], strips.schema)
    assert [(r.chunk_no, r.w, r.pad) for r in st.chunks(wide, 64).orderBy("chunk_no").collect()] == [(0, 64, 0), (1, 40, 24)]


def streamed(spark, frames, parts, files, delay="10 minutes"):
    path = fresh_path(spark, "arrivals")
    for part in parts:
        frames.where(part).coalesce(1).write.mode("append").parquet(path)
    scroll.use_rocksdb(spark)
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).parquet(path)
    log = drain(scroll.fold_stream(source, BAND, delay=delay), "fold")
    return sorted(map(str, log.select("video_id", "frame_idx", "action", "dx", "strip_w").collect()))


def timed(spark, small):
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("frame_idx") * 50)
    return packed(spark, small).where("video_id < 2 and frame_idx < 18").withColumn("ts", at).cache()


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
@pytest.mark.parametrize("files", [1, 1000])
def test_stream_does_not_depend_on_batches_or_order(spark, small, order, files):
    from panoloom.operators.fold import scroll_fold
    frames = timed(spark, small)
    cols = ["video_id", "frame_idx", "action", "dx", "strip_w"]
    assert streamed(spark, frames, [F.expr(f"frame_idx div 6 = {i}") for i in order], files) == sorted(
        map(str, scroll_fold(frames, BAND).select(cols).collect()))


def test_watermark_passes_gaps_and_repeats_are_late(spark, small):
    frames = timed(spark, small)
    parts = [F.expr("frame_idx < 3"), F.expr("frame_idx between 5 and 10"), F.expr("frame_idx >= 11"), F.expr("frame_idx = 17")]
    log = streamed(spark, frames, parts, 1, "100 milliseconds")
    seen = [int(r.split("frame_idx=")[1].split(",")[0]) for r in log if "video_id=0" in r and "late" not in r]
    assert 3 not in seen and 4 not in seen and {0, 1, 2, 5, 10}.issubset(seen) and len(seen) == len(set(seen))
    assert sum("late" in r for r in streamed(spark, frames, [F.lit(True), F.expr("frame_idx = 17")], 1)) == 2


def test_sinks_round_trip(spark, small):
    from panoloom.plans import queries
    from panoloom.sources import sinks
    chunks, pages = fresh_path(spark, "chunks"), fresh_path(spark, "pages")
    sinks.write_chunks(queries()["slice_padded"](spark, small), chunks)
    back = spark.read.parquet(chunks)
    assert back.where("size(v) <> 64 * 16 or name <> format_string('frame_%04d.jpg', chunk_no)").count() == 0
    assert back.count() == queries()["stitch_chunks"](spark, small).count()
    layout = queries()["stitch_layout"](spark, small)
    sinks.write_layout(layout, pages, "video_id")
    assert spark.read.parquet(pages).count() == back.count()


def test_blank_intro(spark, small):
    from panoloom.plans import queries
    rows = queries()["intro_skip"](spark, small).collect()
    assert min(r.frame_idx for r in rows) == 3                       # the first three are blank
    assert any(r.n_ink == 0 for r in rows)                           # a later blank frame stays


def test_own_tables_are_dropped(spark):
    from panoloom import session
    path = session.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    other = f"{session.shared_dir(spark)}/panoloom/other-application/kept"
    spark.range(3).write.mode("overwrite").parquet(other)
    session.drop_stored(spark)
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_bad_frames_are_reported_and_left_out(spark):
    from panoloom.operators import planes
    from panoloom.sources import frames as fr
    whole, cut = [1] * 12, [1] * 11
    rows = [(1, 0, None, 4, 3, "BGR", whole, whole, whole), (1, 1, None, 4, 3, "BGR", whole, cut, whole), (1, 2, None, 4, 3, "XYZ", whole, whole, whole),
            (1, 3, None, 4, 3, "GRAY", whole, None, None), (1, 4, None, None, 3, "RGB", whole, whole, whole), (1, 5, None, 4, 3, None, whole, whole, whole),
            (1, 6, None, 4, 3, "RGB", None, whole, whole)]
    df = spark.createDataFrame(rows, fr.SCHEMA)
    assert {(r.frame_idx, r.reason) for r in fr.bad_frames(df).collect()} == {
        (1, "plane c1 has another size"), (2, "unknown layout"), (4, "no size"), (5, "unknown layout"), (6, "plane c0 has another size")}
    assert sorted(r.frame_idx for r in fr.normalise(df).collect()) == [0, 3]
    loose = df.selectExpr("video_id", "frame_idx", "4 as width", "3 as height", "c0 as b", "c1 as g", "c2 as r")
    assert sorted(r.frame_idx for r in planes.features(loose).collect()) == [0, 2, 4, 5]


def test_unknown_modes_are_null(spark):
    from panoloom.operators.jobs import sheet_mode
    rows = spark.createDataFrame([(" opaque ",), ("Translucent",), ("",), (None,), ("typo",)], "m string").select(sheet_mode(F.col("m"))).collect()
    assert [r[0] for r in rows] == ["OPAQUE", "TRANSLUCENT", "TRANSLUCENT", "TRANSLUCENT", None]
