"""Early stop in waves reads less than all rows."""

from pyspark.sql import functions as F

from panoloom.operators import sampling, waves
from panoloom.plans import jobs_plan
from panoloom.settings import MEASURES_PER_BLOCK
from panoloom.sources import signal as sg


def kept(spark, sf, target):
    s = sampling.target_stop(sg.signal(spark, sf, "event_type"), sg.KEY, sg.ORDER, sg.day(), F.col("event_type") == "purchase", MEASURES_PER_BLOCK, F.expr(target))
    return sorted((r.user_id, r.event_id, r.blocks_before) for r in s.collect())


def test_waves_equal_filter_and_read_less(spark, small):
    reports, target = [], "case when user_id % 2 = 0 then 4 else 8 end"
    got = jobs_plan.stopped_in_waves(spark, small, reports, target)
    assert sorted((r.user_id, r.event_id, r.blocks_before) for r in got.collect()) == kept(spark, small, target)
    rows = [(r.user_id, r.us, r.event_id, r.event_type == "purchase") for r in sg.events(spark, small, "event_type").collect()]
    wave = {w: [] for w, _, _ in reports}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        wave.setdefault(r[1] // (10 * 86_400_000_000), []).append(r)
    blocks, bucket = {}, {r.user_id: r.b for r in sg.events(spark, small).select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(waves.BUCKETS)).alias("b")).distinct().collect()}
    for w, read, worked in reports:
        over = {u for u in bucket if blocks.get(u, 0) * MEASURES_PER_BLOCK >= (4 if u % 2 == 0 else 8)}
        shut = {b for b in bucket.values() if all(u in over for u, x in bucket.items() if x == b)}
        assert read == sum(1 for r in wave[w] if bucket[r[0]] not in shut)
        assert worked == sum(1 for r in wave[w] if r[0] not in over)
        for r in wave[w]:
            blocks[r[0]] = blocks.get(r[0], 0) + r[3] * (r[0] not in over)
    assert sum(read for _, read, _ in reports) < len(rows)
    assert reports[-1][2] < reports[0][2]


def test_shut_buckets_are_not_in_the_scan(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 50 as user_id", "id as n")
    path = str(tmp_path / "w")
    waves.write_waves(rows, path, ["user_id"], F.expr("n div 500"), 4)
    scan = spark.read.parquet(path).where("wave = 1 and bucket not in (0, 2)")
    assert all("bucket=1" in f or "bucket=3" in f for f in {r.f for r in scan.select(F.input_file_name().alias("f")).distinct().collect()})
    assert "PartitionFilters: [isnotnull(wave" in scan._jdf.queryExecution().toString() or "bucket" in scan._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]
