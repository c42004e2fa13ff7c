"""State of streams that ends, and sinks that see each batch once."""

import pytest
from pyspark.sql import functions as F

from panoloom.plans import queries, stream_plan
from panoloom.streaming import events as ev
from panoloom.streaming.runner import RoutedSinks


def test_state_of_ended_videos_goes(spark, small):
    reports = []
    log = stream_plan.expiring(spark, small, reports)
    late = sorted((r.video_id, r.frame_idx) for r in log.where("action = 'late'").collect())
    assert late == [(0, 0), (0, 1), (0, 2)]                     # logged, not a new seed
    seeds = log.where("action = 'seed'").groupBy("video_id").count().collect()
    assert len(seeds) == 5 and all(r["count"] == 1 for r in seeds)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in reports if p["stateOperators"]]
    first = held[0]                                             # one open video
    assert max(held) > first and held[-1] <= first              # at the end only the closing frame's own


def test_tails_are_kept_and_dropped(spark, small):
    tails = queries()["flush_tail_stream"](spark, small)
    frames = stream_plan.packed(spark, small)
    ends = frames.where(F.expr(f"frame_idx % {stream_plan.STRETCH} > 0")).select("video_id", F.expr(f"frame_idx div {stream_plan.STRETCH}")).distinct().count()
    assert 0 < tails.count() < ends


@pytest.fixture
def lines(spark):
    def make(texts):
        return ev.routed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, line string"))
    return make


def held(sinks, lines):
    schema = lines.drop("route").schema
    return {r: sorted((x.batch, x.id, x.payload) for x in sinks.read(r, schema).collect()) for r in sinks.ROUTES}


def test_repeated_batch_changes_neither_sink(spark, lines, tmp_path):
    sinks = RoutedSinks(spark, str(tmp_path / "out"))
    one, two = lines(["FRAME_SAVED:a.jpg", "hello"]), lines(["x", "y", "FRAME_SAVED:b.jpg"])
    assert held(sinks, one) == {"capture": [], "log": []}
    sinks.write(one, 0)
    sinks.write(two, 1)
    want = {"capture": [(0, 0, "a.jpg"), (1, 2, "b.jpg")], "log": [(0, 1, "hello"), (1, 0, "x"), (1, 1, "y")]}
    assert held(sinks, one) == want
    sinks.write(one, 0)
    sinks.write(lines(["other"]), 1)
    assert held(sinks, one) == want


def test_unfinished_batch_is_not_seen_and_is_replaced(spark, lines, tmp_path):
    sinks = RoutedSinks(spark, str(tmp_path / "out"))
    sinks.write(lines(["FRAME_SAVED:a.jpg"]), 0)
    rows = lines(["FRAME_SAVED:b.jpg", "z"])
    rows.where("route = 'capture'").drop("route").write.parquet(str(tmp_path / "out/capture/batch=1"))     # died between the sinks
    assert held(sinks, rows) == {"capture": [(0, 0, "a.jpg")], "log": []}
    sinks.write(rows, 1)
    assert held(sinks, rows) == {"capture": [(0, 0, "a.jpg"), (1, 0, "b.jpg")], "log": [(1, 1, "z")]}
