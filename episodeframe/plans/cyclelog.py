"""Append-only log of training cycles: a row for each task of a cycle, and one for the cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeframe.operators.windows import kappa_changes

SCHEMA = "agent string, model string, cycle int, task string, kind string, gap double, kappa double, predicted_gain double, n_pairs int, logged_at timestamp"


class CycleLog:
    def __init__(self, spark: SparkSession, path: str, agent: str = "agent", model: str = "unknown") -> None:
        self.spark, self.path, self.agent, self.model = spark, path, agent, model

    def append(self, cycle: int, profiles: DataFrame, plan: DataFrame | None = None) -> None:
        """Nothing is written for an empty cycle."""
        rows = profiles.select("task", "kind", "gap", F.col("consistency").alias("kappa"))
        if plan is not None:
            rows = rows.join(plan.select("task", "predicted_gain", F.coalesce(F.size("training_pairs"), F.lit(0)).alias("n_pairs")), "task", "left")
        else:
            rows = rows.withColumns({"predicted_gain": F.lit(None).cast("double"), "n_pairs": F.lit(0)})
        out = rows.select(F.lit(self.agent).alias("agent"), F.lit(self.model).alias("model"), F.lit(cycle).alias("cycle"), "task", "kind", "gap", "kappa", "predicted_gain", "n_pairs", F.current_timestamp().alias("logged_at"))
        if not out.isEmpty():
            out.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def cycles(self) -> DataFrame:
        """(agent, cycle, kappa, delta, plateaued, counts)."""
        c = self.table().groupBy("agent", "cycle").agg(F.avg("kappa").alias("kappa"), F.count(F.lit(1)).alias("n_tasks"), F.sum((F.col("kind") == "recoverable").cast("bigint")).alias("n_recoverable"))
        return kappa_changes(c, ["agent"])

    def export_csv(self, path: str) -> None:
        self.table().orderBy("cycle", "task").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)

    def export_json(self, path: str) -> None:
        """JSON lines in the order of cycle and task; an empty log leaves no file."""
        rows = self.table()
        if not rows.isEmpty():
            rows.orderBy("cycle", "task").write.mode("overwrite").json(path)
