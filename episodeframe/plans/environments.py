"""Training environments for sub-tasks, and their registry as a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodeframe.functions.columns import basename


def task_files(spark: SparkSession, tasks_dir: str) -> DataFrame:
    """(task_base, files map path -> text, seed_data_files): what an episode starts with, without the test and the metadata."""
    root = tasks_dir.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", ".*?" + root.lstrip("/").replace(".", r"\.") + "/([^/]+)/(.*)$", 1).alias("task_base"), F.regexp_extract("path", ".*?" + root.lstrip("/").replace(".", r"\.") + "/([^/]+)/(.*)$", 2).alias("rel"), F.col("content").cast("string").alias("text"))
    keep = ~F.element_at(F.split("rel", "/"), -1).isin("test.sh", "task.toml")
    rows = raw.where(F.col("task_base") != "")
    return rows.groupBy("task_base").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(keep, F.struct("rel", "text"))))).alias("files"), F.array_sort(F.collect_list(F.when(F.col("rel").endswith(".json"), F.col("rel")))).alias("seed_data_files"))


def generate(sub_tasks: DataFrame, files: DataFrame | None = None, tasks_dir: str = "tasks", max_steps: int = 50, timeout_sec: float = 60.0) -> DataFrame:
    """One environment for each sub-task: reward, start, end; a checkpoint's reward needs 0.99, a structural one 0.5."""
    df = sub_tasks.withColumn("task_base", basename(F.col("parent_task")))
    none = F.create_map().cast("map<string,string>")
    df = df.join(files, "task_base", "left") if files is not None else df.withColumns({"files": none, "seed_data_files": F.array().cast("array<string>")})
    checked = F.col("source") == "checkpoint"
    quoted = F.concat(F.lit("'"), F.replace("condition_source", F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    command = F.when(checked & (F.trim(F.coalesce("condition_source", F.lit(""))) != ""), F.concat(F.lit(f"cd {tasks_dir}/"), F.col("task_base"), F.lit(" && bash -c "), quoted))
    threshold = F.when(checked, 0.99).otherwise(0.5)
    return df.select(
        F.col("sub_task_id").alias("task_id"), "parent_task", "sub_task_depth", "instruction", "entry_step", "exit_step", "phase_tag", "source",
        F.struct(F.when(checked, "checkpoint").otherwise("structural").alias("type"), F.col("weight"), threshold.alias("success_threshold"), F.col("checkpoint_id"), F.coalesce(F.when(checked, F.col("condition_source")), F.lit("")).alias("condition_source"), command.alias("verifier_command"), F.col("reward_delta")).alias("reward"),
        F.struct(F.coalesce("files", none).alias("files"), F.concat(F.lit(tasks_dir + "/"), F.col("task_base")).alias("task_dir"), F.coalesce("seed_data_files", F.array().cast("array<string>")).alias("seed_data_files")).alias("initial_state"),
        F.struct(F.lit(max_steps).alias("max_steps"), threshold.alias("success_threshold"), F.lit(timeout_sec).alias("timeout_sec"), F.array().cast("array<string>").alias("require_files")).alias("termination"),
        F.create_map(F.lit("estimated_q_star"), F.col("q_star").cast("string"), F.lit("estimated_q_bar"), F.col("q_bar").cast("string"), F.lit("kind"), F.col("kind")).alias("metadata"),
    )


class Registry:
    """Environments by task_id; every change gives a new registry over a new plan."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def register(self, envs: DataFrame) -> Registry:
        """Later registrations replace earlier ones of the same id."""
        both = self.df.withColumn("_o", F.lit(0)).unionByName(envs.withColumn("_o", F.lit(1)))
        last = both.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("_o")))).where("_n = 1")
        return Registry(last.drop("_o", "_n"))

    def unregister(self, task_id: str) -> Registry:
        return Registry(self.df.where(F.col("task_id") != task_id))

    def get(self, task_id: str) -> DataFrame:
        return self.df.where(F.col("task_id") == task_id)

    def by_parent(self, parent: str) -> DataFrame:
        return self.df.where(F.col("parent_task") == parent)

    def by_phase(self, tag: str) -> DataFrame:
        return self.df.where(F.col("phase_tag") == tag)

    def task_ids(self) -> DataFrame:
        return self.df.select("task_id").orderBy("task_id")

    def parents(self) -> DataFrame:
        return self.df.select("parent_task").distinct().orderBy("parent_task")

    def _mark(self, where: Column, **values) -> Registry:
        entries = [x for k, v in values.items() for x in (F.lit(k), v)]
        keys = list(values)
        kept = F.map_filter("metadata", lambda k, v: ~k.isin(*keys))
        return Registry(self.df.withColumn("metadata", F.when(where, F.map_concat(kept, F.create_map(*entries))).otherwise(F.col("metadata"))))

    def retire(self, task_id: str, reason: str = "completed") -> Registry:
        return self._mark(F.col("task_id") == task_id, status=F.lit("retired"), retired_reason=F.lit(reason), retired_at=F.current_timestamp().cast("string"))

    def recompute_status(self, profiles: DataFrame) -> Registry:
        """Status of every environment with a profile (task, kind) of its id."""
        p = profiles.select(F.col("task").alias("task_id"), F.col("kind").alias("_kind"))
        kept = F.map_filter("metadata", lambda k, v: k != "status")
        df = self.df.join(p, "task_id", "left")
        return Registry(df.withColumn("metadata", F.when(F.col("_kind").isNotNull(), F.map_concat(kept, F.create_map(F.lit("status"), F.col("_kind")))).otherwise(F.col("metadata"))).drop("_kind"))

    def invalidate(self, boundary_hash: str) -> Registry:
        return Registry(self.df.where(~F.col("metadata")["boundary_hash"].eqNullSafe(boundary_hash)))

    def active(self) -> DataFrame:
        return self.df.where(~F.col("metadata")["status"].eqNullSafe("retired"))

    def export(self, path: str) -> None:
        """Active environments as JSON lines."""
        self.active().write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, schema) -> Registry:
        return cls(spark.read.schema(schema).json(path))
