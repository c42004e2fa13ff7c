"""Chunk files show whole jobs only."""

import pytest
from pyspark.sql import functions as F

from panoloom.sources import images


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(images.ChunkFiles)


def chunks(spark, n, first=0):
    return spark.range(first, first + n, numPartitions=4).selectExpr("id % 3 as video_id", "id as chunk_no", "2 as width", "3 as height", "cast('abcdef' as binary) as v")


def read(spark, path):
    return sorted((r.video_id, r.chunk_no, r.width, r.height, bytes(r.v)) for r in spark.read.format("chunk_files").option("path", path).load().collect())


def write(df, path, mode="append"):
    df.write.format("chunk_files").option("path", path).mode(mode).save()


def test_one_file_per_chunk(spark, tmp_path):
    path = str(tmp_path / "out")
    write(chunks(spark, 200), path)
    assert read(spark, path) == sorted((i % 3, i, 2, 3, b"abcdef") for i in range(200))
    files = {f.name for f in tmp_path.rglob("*.pgm")}
    assert len(files) == 200 and "frame_0007.pgm" in files
    assert next(tmp_path.rglob("frame_0007.pgm")).read_bytes() == b"P5\n2 3\n255\nabcdef"


def test_failed_task_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write(chunks(spark, 5), path)
    bad = chunks(spark, 40, 100).withColumn("v", F.when(F.col("chunk_no") == 137, F.expr("cast('ab' as binary)")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="137"):
        write(bad, path)
    assert [r[1] for r in sorted(read(spark, path), key=lambda r: r[1])] == list(range(5))
    assert len(list(tmp_path.rglob("*.pgm"))) == 5          # what was written is gone again


def test_modes_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    assert read(spark, path) == []
    write(chunks(spark, 3), path)
    write(chunks(spark, 2, 10), path)
    assert len(read(spark, path)) == 5
    write(chunks(spark, 4, 20), path, "overwrite")
    assert sorted(r[1] for r in read(spark, path)) == [20, 21, 22, 23]
