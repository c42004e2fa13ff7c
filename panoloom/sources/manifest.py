"""URL manifests: command-line arguments first, then the lines of a text file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.functions.text import strip_blank
from panoloom.operators.segments import number_rows
from panoloom.session import stored
from panoloom.settings import NUMBERING_SPAN, SHEET_NAME

ORDER = ["src", "part", "line"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in reading order: (src, part, line, url)."""
    return (spark.read.text(path)
            .select(F.lit(1).alias("src"),
                    F.struct(F.col("_metadata.file_path").alias("file"),
                             F.col("_metadata.file_block_start").alias("start")).alias("part"),
                    F.monotonically_increasing_id().alias("line"), F.col("value").alias("url")))


def arguments(df: DataFrame, order: str, part) -> DataFrame:
    """Positional URLs in the same shape."""
    return df.select(F.lit(0).alias("src"), part.alias("part"), F.col(order).alias("line"), "url")


def manifest(args: DataFrame, lines: DataFrame) -> DataFrame:
    """(pos, url, title) of all URLs; blank and comment lines are dropped before numbering.

    Lines are written once, since their numbers depend on how a scan is split and numbering reads them twice.
    """
    kept = (lines.withColumn("url", strip_blank("url"))
            .where((F.col("url") != "") & ~F.startswith("url", F.lit("#"))))
    both = stored(args.unionByName(kept).withColumn("job", F.lit(0)), "lines")
    seg = F.struct("src", "part", F.expr(f"line div {NUMBERING_SPAN}"))
    return (number_rows(both, ["job"], ["line"], seg)
            .select((F.col("n") + 1).alias("pos"), "url",
                    F.format_string(SHEET_NAME, F.col("n") + 1).alias("title")))
