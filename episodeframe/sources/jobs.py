"""Folders of agent jobs: ``<job>/<trial>/result.json`` with rewards, configuration and trajectories beside it.

Trials come from the data source ``agent_jobs`` (``job_source``): one listing of
a job plans the read, each trial is one row with the texts of its files.
"""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodeframe.functions.columns import basename
from episodeframe.operators.trajectory import features, tool_sequence
from episodeframe.schema import TRAJECTORY
from episodeframe.sources import job_source

THRESHOLD = 0.99


#: ``ord`` of a job lies below this power of two
JOB_BITS = 50


def reward(sidecar: Column, text: Column, result: Column, key: str | None) -> Column:
    """Scalar of reward.json, else reward.txt, else the result's fields; a map gives ``key`` or the mean of its numbers."""
    from_result = F.coalesce(*(F.get_json_object(result, p) for p in ("$.verifier_result.reward", "$.verifier_result.reward.value", "$.agent_result.reward", "$.reward")))
    raw = F.when(sidecar.isNotNull(), sidecar).when(text.isNotNull(), F.trim(text)).otherwise(from_result)
    named = F.from_json(raw, "map<string,string>")
    numbers = F.filter(F.transform(F.map_values(named), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    mean = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))
    chosen = F.coalesce(named[key].try_cast("double"), mean) if key else mean
    return F.coalesce(raw.try_cast("double"), chosen)


def task_metadata(spark: SparkSession, tasks_dir: str) -> DataFrame:
    """(name, difficulty, category, explanation) of every task.toml, by full name and by its last part."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "task.toml").option("recursiveFileLookup", "true").load(tasks_dir).select("path", "content")

    def parse(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    doc = tomllib.loads(raw.decode("utf-8"))
                except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                    continue
                name, meta = str(doc.get("task", {}).get("name") or ""), doc.get("metadata") or {}
                if name:
                    about = tuple(str(meta.get(k, d)) for k, d in (("difficulty", "unknown"), ("category", "unknown"), ("difficulty_explanation", "")))
                    out += [(n, *about) for n in dict.fromkeys((name, name.split("/")[-1]))]
            names = ["name", "difficulty", "category", "explanation"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=names)

    found = files.mapInArrow(parse, "name string, difficulty string, category string, explanation string")
    return found.groupBy("name").agg(F.max(F.struct("difficulty", "category", "explanation")).alias("m")).select("name", "m.*")


def _episodes(trials: DataFrame, run_id: Column, reward_key: str | None = None, threshold: float = THRESHOLD, strata_from_config: tuple[str, ...] = (), tasks_dir: str | None = None) -> DataFrame:
    """Trials' texts as episodes with ``ord``, not yet numbered within their task; every column comes from its own row."""
    dig = lambda c, p: F.nullif(F.get_json_object(c, p), F.lit(""))
    df = trials.select(
        run_id.alias("run_id"), "trial", "result", "config",
        F.coalesce(dig("result", "$.task_name"), dig("result", "$.task_id"), basename(F.col("trial"))).alias("task"),
        F.coalesce(dig("result", "$.agent_info.model"), dig("config", "$.model"), F.lit("unknown")).alias("model"),
        reward(F.col("reward_json"), F.col("reward_txt"), F.col("result"), reward_key).alias("reward"),
        (F.shiftleft(F.col("run").cast("bigint"), JOB_BITS) + F.col("place")).alias("ord"),
    )
    strata = [(k, dig("config", f"$.{k}")) for k in strata_from_config]
    if tasks_dir:
        meta = task_metadata(trials.sparkSession, tasks_dir).withColumnRenamed("name", "task")
        df = df.join(meta, "task", "left")
        strata = [("difficulty", F.col("difficulty")), ("category", F.col("category")), *strata]
    pairs = F.create_map(*(x for k, v in strata for x in (F.lit(k), v))) if strata else F.create_map().cast("map<string,string>")
    score = F.coalesce("reward", F.lit(0.0))
    success = F.coalesce(F.col("reward") >= threshold, F.lit(False))
    return df.select(
        "run_id", "model", "task", score.alias("score"), success.alias("success"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("strata"),
        F.when(F.col("reward").isNull(), "missing_reward").when(~success, "below_threshold").alias("failure_mode"), F.lit(None).cast("int").alias("length"), F.col("trial").alias("trajectory_ref"),
        F.to_json(F.struct(F.get_json_object("result", "$.trial_name").alias("trial_name"))).alias("meta"), "ord",
    )


_FILES = ("result", "config", "reward_json", "reward_txt")


def _numbered(df: DataFrame) -> DataFrame:
    """``episode``: the place of a trial among those of its task in its run."""
    counted = df.withColumn("episode", (F.row_number().over(Window.partitionBy("run_id", "task").orderBy("ord")) - 1).cast("int"))
    return counted.select("run_id", "model", "task", "episode", *(c for c in df.columns if c not in ("run_id", "model", "task")))


def read_job(spark: SparkSession, job_dir: str, run_id: str | None = None, **options) -> DataFrame:
    """One job as episodes, numbered within their task; ``ord`` follows the trials' names over the whole job; no reward means score 0, ``missing_reward``."""
    job_dir = job_dir.rstrip("/")
    trials = job_source.read_texts(spark, [job_dir], _FILES)
    return _numbered(_episodes(trials, F.lit(run_id or job_dir.rsplit("/", 1)[-1]), **options))


def read_jobs(spark: SparkSession, job_dirs: list[str], **options) -> DataFrame:
    """Several jobs as repeats, in one read: run_id job0, job1, ...; ``ord`` goes on from job to job."""
    if not job_dirs:
        raise ValueError("no job folders")
    trials = job_source.read_texts(spark, job_dirs, _FILES)
    return _numbered(_episodes(trials, F.concat(F.lit("job"), F.col("run").cast("string")), **options))


def stream_jobs(spark: SparkSession, job_dirs: list[str], settle: float = job_source.SETTLE, **options) -> DataFrame:
    """Episodes of growing job folders as their trials end; ``episode`` and ``ord`` need the whole job and are absent."""
    trials = job_source.stream_texts(spark, job_dirs, _FILES, settle=settle)
    return _episodes(trials, F.concat(F.lit("job"), F.col("run").cast("string")), **options).drop("ord")


def _trajectories(runs: DataFrame) -> DataFrame:
    parsed = runs.withColumn("doc", F.from_json("trajectory", TRAJECTORY)).withColumn("score", F.trim("reward_txt").try_cast("double"))
    parsed = parsed.where(F.expr("try_parse_json(trajectory)").isNotNull() & F.col("score").isNotNull())
    agent = F.coalesce(F.nullif(F.get_json_object("config", "$.agent.name"), F.lit("")), F.get_json_object("trajectory", "$.agent.name"), F.lit("unknown"))
    rows = parsed.select(
        basename(F.col("trial")).alias("trial_id"), F.coalesce(F.get_json_object("config", "$.task.path"), F.lit("")).alias("task_path"), agent.alias("agent_name"), "score", F.coalesce(F.col("doc.steps"), F.array().cast(TRAJECTORY["steps"].dataType)).alias("steps"), F.concat("trial", F.lit("/agent/trajectory.json")).alias("traj_path")
    )
    return features(rows.withColumn("tool_sequence", tool_sequence("steps")).drop("steps"))


def read_trajectories(spark: SparkSession, job_dir: str) -> DataFrame:
    """Trials with both trajectory.json and a numeric reward.txt, with tool sequence and features; broken files are skipped."""
    return _trajectories(job_source.read_texts(spark, [job_dir], ("config", "reward_txt", "trajectory"), "trajectory,reward_txt"))


def read_trajectory_dirs(spark: SparkSession, job_dirs: list[str]) -> DataFrame:
    """All folders in one read; one without trials (with both files) of its own is looked into one level deeper."""
    return _trajectories(job_source.read_texts(spark, job_dirs, ("config", "reward_txt", "trajectory"), "trajectory,reward_txt", deeper=True))
