"""Run a bounded stream to its end into files of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panoloom.session import exists, fresh_path


def drain(stream: DataFrame, name: str, *partitions: str, progress: list | None = None) -> DataFrame:
    """Process everything available, return the written table; ``progress`` takes the reports of the batches."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    writer = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
              .option("checkpointLocation", f"{out}-state"))
    if partitions:
        writer = writer.partitionBy(*partitions)
    query = writer.start(out)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process everything available in update mode, return the last row of each key.

    A batch that is repeated after a failure replaces its own files.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (stream.writeStream.outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", f"{out}-state").foreachBatch(write).start())
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", out).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest])


class RoutedSinks:
    """Two tables, ``capture`` and ``log``, fed by one stream, with a ledger of finished batches.

    A batch is written to both tables and then entered in the ledger. A batch that comes again after a failure is left alone if the ledger has it and else
    replaces its own unfinished files, and readers only see batches of the ledger: no line is lost, doubled or visible in one table only.
    """

    ROUTES = ("capture", "log")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        """A ``foreachBatch`` function over ``events.routed`` rows."""
        if exists(self.spark, f"{self.path}/ledger/batch={batch}/_SUCCESS"):
            return
        rows.persist()
        for route in self.ROUTES:
            rows.where(F.col("route") == route).drop("route").write.mode("overwrite").parquet(f"{self.path}/{route}/batch={batch}")
        done = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
        done.write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        rows.unpersist()

    def read(self, route: str, schema: StructType) -> DataFrame:
        """Lines of one route with their batch; ``schema`` is that of the written rows."""
        if not exists(self.spark, f"{self.path}/ledger"):
            return self.spark.createDataFrame([], schema.add("batch", "long"))
        done = self._table("ledger", StructType().add("route", "string").add("n", "long")).select("batch").distinct()
        return self._table(route, schema).join(done, "batch", "left_semi")

    def _table(self, name: str, schema: StructType) -> DataFrame:
        full = StructType(schema.fields).add("batch", "long")
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def drain(self, routed: DataFrame, checkpoint: str) -> None:
        """Process everything available."""
        query = (routed.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(self.write).start())
        query.awaitTermination()
        if query.exception():
            raise query.exception()
