"""From raw documents to a training mix, in five stages that are each written and read again.

1. ``toxicity``: documents whose predicted chance of a toxic grade is one half or more go.
2. ``near_copies``: one document of each group of near copies stays.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``secrets``: secrets are masked in place; every document stays.
5. ``mix``: the remaining documents are mixed to source weights; the result says beside each text how many of its words the mix takes, repeats counted.

Every stage works on what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoloom.llm import common, decontam, mixing, near, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the model is trained on the labelled documents among the input."""
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, prefix="__").where(~F.col("__toxic")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Trained models, MinHash and latent semantics are not SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a table in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
