"""Failure modes and rubric criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.functions.columns import known_keys


def failure_distribution(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(keys, failure_mode, n, share_of_failures) of the episodes without success; a null mode is ``unlabeled``."""
    if missing := [c for c in by if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    fails = known_keys(df, by).where(~F.col("success"))
    counts = fails.groupBy(*by, F.coalesce("failure_mode", F.lit("unlabeled")).alias("failure_mode")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_of_failures", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def criterion_failure_rates(df: DataFrame, by: list[str] = (), criteria: str = "criteria") -> DataFrame:
    """(keys, criterion, n_episodes, n_failed, failure_rate) of a map criterion -> passed; absent ones don't count."""
    long = df.select(*by, F.explode(criteria).alias("criterion", "passed"))
    out = known_keys(long, by).groupBy(*by, "criterion").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum((~F.coalesce("passed", F.lit(False))).cast("bigint")).alias("n_failed"))
    return out.withColumn("failure_rate", F.col("n_failed") / F.col("n_episodes"))


def top_failing_criteria(df: DataFrame, n: int = 5, by: list[str] = (), criteria: str = "criteria") -> DataFrame:
    """The ``n`` criteria that fail most; ties by name."""
    return criterion_failure_rates(df, by, criteria).orderBy(F.desc("failure_rate"), "criterion", *by).limit(n)
