"""Cutting lineage with Spark's checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder: ``spark.checkpoint.dir``, or one of our own on a single machine only."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoints-')}")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder; Spark removes it with the last plan that reads it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
