"""The end-to-end job: isolation, sizes, and the ledger."""

import pytest
from pyspark.sql import functions as F

from panoloom.operators import steps
from panoloom.operators import stitch
from panoloom.operators.match import Band
from panoloom.plans import score, score_plan
from panoloom.sources import camera as cam
from panoloom.sources.ledger import Ledger

JOB = "video_id long, mode string, every int, first_us long, last_us long, x int, y int, w int, h int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stored(spark, small):
    return cam.planes(spark, small).withColumnsRenamed({"b": "c0", "g": "c1", "r": "c2"}).withColumn("layout", F.lit("BGR")).where("frame_idx < 24").cache()


def jobs_of(spark, regions):
    return spark.createDataFrame([(v, "opaque" if v % 2 else None, None, None, None, *r) for v, r in regions.items()], JOB)


WHOLE = (None,) * 4


def test_an_exception_in_one_video_stops_no_other(spark, stored):
    def broken_step(band):
        step = steps.scroll_step(band)

        def run(frames, state, known):
            if frames["video_id"].iat[0] == 2:
                raise ValueError("no luck")
            return step(frames, state, known)
        return run

    jobs = jobs_of(spark, {0: WHOLE, 1: WHOLE, 2: WHOLE})
    status, chunks, pages = score.run_job(jobs, stored, scroll=broken_step)
    got = {r.video_id: (r.status, r.error) for r in status.collect()}
    assert got == {0: ("ok", None), 1: ("ok", None), 2: ("failed", "ValueError: no luck")}
    assert {r.video_id for r in chunks.collect()} == {r.video_id for r in pages.collect()} == {0, 1}
    want = score.run_job(jobs.where("video_id < 2"), stored)
    assert rows(chunks) == rows(want[1]) and rows(pages) == rows(want[2])


def test_sizes_in_one_pass_equal_sizes_on_their_own(spark, stored):
    regions = {0: (0, 0, 48, 16), 1: (8, 2, 56, 12), 2: WHOLE, 3: (30, 4, 999, 999)}      # the last one leaves the frame
    sizes = {0: (48, 16), 1: (56, 12), 2: (64, 16), 3: (34, 12)}
    jobs = jobs_of(spark, regions)
    status, chunks, _ = score.run_job(jobs, stored)
    assert {r.video_id: r.error for r in status.collect()} == dict.fromkeys(regions)
    want = []
    for v, (w, h) in sizes.items():
        band = Band(w, h)
        part = score.prepare(stored.where(F.col("video_id") == v), jobs)
        assert {(r.width, r.height) for r in part.select("width", "height").distinct().collect()} == {(w, h)}
        want += rows(stitch.chunks(score.strips_of(score.decide(part, band, F.col("mode")), band), w))
    assert rows(chunks) == sorted(want, key=str)


def test_bad_jobs_give_rows(spark, stored):
    jobs = spark.createDataFrame([(0, None, 0, None, None, *WHOLE), (1, None, 1, 9, 3, *WHOLE), (2, None, 1, None, None, *WHOLE), (2, "opaque", 1, None, None, *WHOLE),
                                  (3, None, 1, None, None, 0, 0, -5, 4)], JOB)
    status, _, _ = score.run_job(jobs, stored)
    got = sorted((r.video_id, r.status, r.error) for r in status.distinct().collect())
    assert [r[:2] for r in got] == [(0, "failed"), (1, "failed"), (2, "failed"), (3, "ok")]
    assert status.count() == 5
    none, chunks, pages = score.run_job(jobs.limit(0), stored)
    assert none.count() == chunks.count() == pages.count() == 0


def test_killed_job_goes_on_where_it_stopped(spark, stored, tmp_path):
    jobs = jobs_of(spark, {0: WHOLE, 1: WHOLE, 2: WHOLE})
    calls = []

    def dies(j, f):
        calls.append(sorted(r.video_id for r in j.collect()))
        if len(calls) == 2:
            raise RuntimeError("killed")
        return score.run_job(j, f)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(RuntimeError):
        ledger.run(jobs, stored, dies, wave=1)
    first = {r.video_id: r.run for r in ledger.entries().collect()}
    assert sorted(first) == calls[0]
    (tmp_path / "ledger/chunks/run=left").mkdir()            # what a killed wave may leave behind
    done = ledger.run(jobs, stored, score.run_job, wave=1)
    after = {r.video_id: r.run for r in done.collect()}
    assert sorted(after) == [0, 1, 2] and all(after[v] == run for v, run in first.items())
    whole = score.run_job(jobs, stored)
    assert rows(ledger.results(done, "chunks").drop("job", "run")) == rows(whole[1])
    assert rows(ledger.results(done, "pages").drop("job", "run")) == rows(whole[2])
    assert rows(done.select("video_id", "status", "error", "n_chunks")) == rows(whole[0])
    before = len(ledger._versions())
    ledger.run(jobs, stored, dies)                            # nothing is pending
    assert len(ledger._versions()) == before


def test_ledger_query_reads_stored_frames(spark, small, monkeypatch):
    """Frames are built once, not by every wave."""
    seen = []

    class Stop(Exception):
        pass

    def run(self, jobs, frames, work, wave=1000):
        seen.append(frames.inputFiles())
        raise Stop
    monkeypatch.setattr(Ledger, "run", run)
    with pytest.raises(Stop):
        score_plan.score_ledger(spark, small)
    assert seen[0] and not any("embeddings" in f for f in seen[0])
