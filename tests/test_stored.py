"""Tables in the shared folder."""

import pathlib

from pyspark.sql import functions as F

from panoloom.session import CLEANUP, collected, stored


def shuffles(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for folder in manager.localDirsString() for p in pathlib.Path(folder).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_write(spark):
    before, kept = shuffles(spark), spark.conf.get(CLEANUP, "false")
    rows = spark.range(100_000).repartition(5, F.col("id") % 13).groupBy((F.col("id") % 1000).alias("k")).count()
    assert stored(rows, "counted").count() == 1000
    assert not {p for p in shuffles(spark) - before if pathlib.Path(p).stat().st_size > 20_000}
    assert spark.conf.get(CLEANUP, "false") == kept


def test_shuffle_files_go_with_the_rows(spark):
    before, kept = shuffles(spark), spark.conf.get(CLEANUP, "false")
    rows = spark.range(100_000).repartition(5, F.col("id") % 13).groupBy((F.col("id") % 1000).alias("k")).count()
    assert sorted(r["count"] for r in collected(rows)) == [100] * 1000
    assert not {p for p in shuffles(spark) - before if pathlib.Path(p).stat().st_size > 20_000}
    assert spark.conf.get(CLEANUP, "false") == kept
