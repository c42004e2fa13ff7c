"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", app: str = "panoloom") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PANOLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and all runs in one process, a private one that goes at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="panoloom-")         # one process: driver and tasks share its disk
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def settle(df):
    """Checkpoint ``df`` in the shared folder, cutting its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_own_tables(spark)}/{name}-{uuid.uuid4().hex}"


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/panoloom/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables and stream outputs this application has written to the shared folder.

    For the end of a job, when its results are written elsewhere: lazy results read these tables.
    """
    jvm, path = spark.sparkContext._jvm, _own_tables(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def _files_go(spark: SparkSession):
    """What is planned inside drops its shuffle files when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df, name: str):
    """Write ``df`` as a table in the shared folder and return it; for wide tables that are read repeatedly. Its shuffle files go."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with _files_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df) -> list:
    """The rows of a small result of a large shuffle, whose files go."""
    with _files_go(df.sparkSession):
        return df.select("*").collect()
