"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.session import collected, stored

__all__ = ["read", "stored", "collected", "text_of", "row_key", "KEY", "tasks"]

#: Columns that identify a row of documents: its number and a hash of its text, so that repeated numbers stay apart.
KEY = ("__did", "__tid")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``KEY`` for a row; repeated rows share it, which is right wherever equal rows get equal results."""
    return [F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias(KEY[0]),
            F.xxhash64(F.col(id_col).isNull(), text_of(text_col)).alias(KEY[1])]


def tasks(spark: SparkSession) -> int:
    """The configured number of shuffle partitions, for rows that unfold in Python."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
