"""A ledger of finished jobs, so that a job that was killed does only what is still pending.

Jobs run in waves. A wave's chunks and pages are written to a folder of their own; then the wave is entered, in one table of a new version whose ``_SUCCESS`` file
makes it count. Readers take results of entered waves only, so what a killed wave left behind is never seen and its jobs are done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.operators.jobs import pending
from panoloom.session import exists, settle

ENTRY = "job string, video_id bigint, status string, error string, n_chunks bigint, run string, version bigint"
PARAMETERS = ("video_id", "mode", "every", "first_us", "last_us", "x", "y", "w", "h")


def job_key() -> Column:
    """A job is its video with all its parameters: another region or mode is another job."""
    return F.sha2(F.to_json(F.struct(*PARAMETERS)), 256)


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        """Folders of the finished versions; one per wave."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().toString() for s in fs.listStatus(root)]
        return [n for n in names if exists(self.spark, f"{n}/_SUCCESS")]

    def entries(self) -> DataFrame:
        """The latest entry of every job."""
        done = self._versions()
        rows = self.spark.read.schema(ENTRY).parquet(*done) if done else self.spark.createDataFrame([], ENTRY)
        rest = [c.split()[0] for c in ENTRY.split(", ")[1:]]
        return rows.groupBy("job").agg(F.max_by(F.struct(*rest), "version").alias("e")).select("job", "e.*")

    def _enter(self, rows: DataFrame) -> None:
        version = 1 + (self.entries().agg(F.max("version")).first()[0] or 0)
        rows.withColumn("version", F.lit(version).cast("bigint")).write.parquet(f"{self.path}/entries/v{version:09d}-{uuid.uuid4().hex}")

    def run(self, jobs: DataFrame, frames: DataFrame, work: Callable, wave: int = 1000) -> DataFrame:
        """Run what is pending of ``jobs`` by ``work(jobs, frames)``, ``wave`` videos at a time, and return the entries of all of them.

        Jobs that failed before are tried again; all others are taken from the ledger.
        """
        asked = jobs.withColumn("job", job_key())
        todo = settle(pending(asked, self.entries().where("status <> 'failed'"), "job"))
        waves = -(-todo.count() // wave)
        for k in range(waves):
            # rows of one video stay together; entries of earlier waves do not change the split of the rest
            part = todo.where(F.pmod(F.xxhash64("video_id"), F.lit(waves)) == k)
            keys = part.groupBy("video_id").agg(F.first("job").alias("job"))
            run = uuid.uuid4().hex
            status, chunks, pages = work(part.drop("job"), frames)
            chunks.join(keys, "video_id").write.parquet(f"{self.path}/chunks/run={run}")
            pages.join(keys, "video_id").write.parquet(f"{self.path}/pages/run={run}")
            entered = status.distinct().join(keys, "video_id").select("job", "video_id", "status", "error", "n_chunks", F.lit(run).alias("run"))
            self._enter(entered)
        return self.entries().join(asked.select("job").distinct(), "job", "left_semi")

    def results(self, entries: DataFrame, table: str) -> DataFrame:
        """``chunks`` or ``pages`` of entered jobs; only the runs they name are read."""
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return rows.join(entries.select("job", "run"), ["job", "run"], "left_semi")
