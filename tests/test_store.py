"""The clustered frame store opens few files and pushes its filters."""

import pytest
from pyspark.sql import functions as F

from panoloom.sources import store


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("store") / "s")
    store.write_store(spark.range(4000).selectExpr("id % 8 as video_id", "id div 8 as frame_idx", "(id div 8) * 1000 as ts_us"), p, 32)
    return p


def opened(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_files_hold_ranges(spark, path):
    index = sorted(((r.video_id, r.from_us), (r.video_id, r.to_us)) for r in store.read_index(spark, path).collect())
    assert len(index) > 16 and all(a[1] < b[0] for a, b in zip(index, index[1:]))


def test_numbers_far_apart(spark, tmp_path):
    p = str(tmp_path / "far")
    store.write_store(spark.createDataFrame([(1, 0, 5), (10 ** 15, 0, 5)], "video_id long, frame_idx long, ts_us long"), p, 1)
    wanted = spark.createDataFrame([(10 ** 15, 3)], "video_id long, at_us long")
    assert [tuple(r) for r in store.frames_at(spark, p, wanted).collect()] == [(10 ** 15, 3, 5, 0)]


def test_slice_opens_only_its_files(spark, path):
    wanted = spark.createDataFrame([(3, 100_000, 130_000), (5, None, 4_000), (99, 0, 5)], "video_id long, first_us long, last_us long")
    df = store.slices(spark, path, wanted)
    got = sorted((r.video_id, r.frame_idx) for r in df.collect())
    assert got == [(3, i) for i in range(100, 131)] + [(5, i) for i in range(5)]
    total = store.read_index(spark, path).select("file").distinct().count()
    frames = {f for f in opened(df) if f in {r.file.rsplit("/", 1)[1] for r in store.read_index(spark, path).collect()}}
    assert 1 <= len(frames) <= 4 < total
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(video_id)" in plan and "GreaterThanOrEqual(video_id,3)" in plan


def test_point_lookups_open_one_file_each(spark, path):
    wanted = spark.createDataFrame([(0, 0), (2, 77_500), (7, 499_000), (7, 499_001), (50, 1)], "video_id long, at_us long")
    df = store.frames_at(spark, path, wanted)
    assert sorted((r.video_id, r.at_us, r.frame_idx) for r in df.collect()) == [(0, 0, 0), (2, 77_500, 78), (7, 499_000, 499)]
    names = {r.file.rsplit("/", 1)[1] for r in store.read_index(spark, path).collect()}
    assert len(opened(df) & names) <= 3


def test_last_frame_of_a_file_and_ties(spark, path):
    ends = store.read_index(spark, path).selectExpr("video_id", "to_us as ts_us").collect()
    wanted = spark.createDataFrame([(r["video_id"], r["ts_us"]) for r in ends], "video_id long, at_us long")
    got = store.frames_at(spark, path, wanted).where(F.col("at_us") == F.col("ts_us"))
    assert got.count() == len(ends)
