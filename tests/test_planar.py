"""The planar data source beside the frames that were written."""

import json
from dataclasses import asdict

import pytest

from panoloom.sources import planar
from panoloom.streaming.runner import drain


def frames(spark, videos=3, n=40, first=0, step=1):
    """Frames of 4 x 2 pixels; every fifth has no time, video 1 is gray."""
    gray = "case when video_id = 1 then null else {} end"
    plane = "transform(sequence(0, 7), i -> cast((frame_idx * 7 + video_id + i * {k}) % 256 as smallint))"
    return (spark.range(videos * n, numPartitions=4)
            .selectExpr(f"id % {videos} as video_id", f"(id div {videos} + {first}) * {step} as frame_idx")
            .selectExpr("video_id", "frame_idx", "case when frame_idx % 5 > 0 then frame_idx * 50000 end as ts_us", "4 as width", "2 as height",
                        "case when video_id = 1 then 'GRAY' else 'BGR' end as layout", f"{plane.format(k=1)} as c0",
                        f"{gray.format(plane.format(k=2))} as c1", f"{gray.format(plane.format(k=3))} as c2"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def test_round_trip_with_gaps(spark, tmp_path):
    path = str(tmp_path / "out")
    df = frames(spark, step=3)
    planar.write_planar(df, path)
    assert rows(planar.read_planar(spark, path)) == rows(df)
    planar.write_planar(frames(spark, n=5, first=1000), path)
    assert planar.read_planar(spark, path).count() == 135


@pytest.mark.parametrize("condition", ["video_id = 1", "video_id in (0, 2) and frame_idx between 7 and 20", "frame_idx > 30", "frame_idx <= 3 and width = 4", "frame_idx = 12",
                                       "video_id = 1 and video_id = 2", "frame_idx < 5 or video_id = 2", "ts_us is null", "video_id is null"])
def test_filters(spark, tmp_path, condition):
    path = str(tmp_path / "out")
    df = frames(spark)
    planar.write_planar(df, path)
    assert rows(planar.read_planar(spark, path).where(condition)) == rows(df.where(condition))


def test_filters_reach_the_source_and_leave_out_blocks(spark, tmp_path):
    path = str(tmp_path / "out")
    planar.write_planar(frames(spark), path)
    found = planar.read_planar(spark, path).where("video_id = 2 and frame_idx >= 38")
    assert found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "")         # applied in full by the source
    assert found.rdd.getNumPartitions() < planar.read_planar(spark, path).rdd.getNumPartitions()


def test_blocks_of_a_long_file(tmp_path):
    long = planar.Segment("f", 7, 4, 2, "BGR", 10, 95, list(range(0, 200, 20)), 188)
    (tmp_path / "_commits").mkdir()
    (tmp_path / "_commits" / "000000000000-x.json").write_text(json.dumps(asdict(long)))

    def records(**wanted):
        return [(b.first, b.end) for b in planar._blocks(str(tmp_path), planar.Wanted(**wanted))]

    assert records() == [(k, min(k + 10, 95)) for k in range(0, 95, 10)]
    assert records(low=45, high=61) == [(20, 30), (30, 40)]
    assert records(low=185) == [(90, 95)] and records(low=189) == [] and records(videos=frozenset([6])) == []


def test_failed_task_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    planar.write_planar(frames(spark, n=4), path)
    with pytest.raises(Exception, match="plane of another size"):
        planar.write_planar(frames(spark, first=100).selectExpr("video_id", "frame_idx", "ts_us", "if(frame_idx = 120, 5, width) as width", "height", "layout", "c0", "c1", "c2"), path)
    assert planar.read_planar(spark, path).count() == 12
    assert len(list(tmp_path.rglob("run-*"))) == 1
    with pytest.raises(Exception, match="appends only"):
        frames(spark).write.format("planar_frames").option("path", path).mode("overwrite").save()


def test_stream_goes_on_from_its_commits(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert planar.read_planar(spark, path).count() == 0

    def run():
        q = (planar.stream_planar(spark, path).writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", out + "-state").start(out))
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    planar.write_planar(frames(spark, n=10), path)
    assert run() == 30
    planar.write_planar(frames(spark, n=5, first=10), path)
    assert run() == 15                                      # only what is new
    assert rows(spark.read.parquet(out)) == rows(frames(spark, n=15))
    assert rows(drain(planar.stream_planar(spark, path), "again")) == rows(frames(spark, n=15))
