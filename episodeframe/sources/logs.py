"""Evaluation logs of other harnesses: sample logs and benchmark predictions with results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodeframe.operators.scans import row_numbers
from episodeframe.sources.generic import in_file_order

# Actions of a shell agent and the canonical tools they stand for.
ACTIONS = {
    "read": "read_file",
    "view": "read_file",
    "edit": "write_file",
    "write": "write_file",
    "bash": "run_shell_command",
    "run": "run_shell_command",
    "execute": "run_shell_command",
    "test": "run_shell_command",
    "submit": "submit",
    "finish": "submit",
    "search": "grep_search",
    "find": "list_directory",
}


def default_score(sample: Column) -> Column:
    """``score.value`` or ``score``: a number, or "C" / "CORRECT" / "TRUE" / "1" for 1."""
    raw = F.coalesce(F.get_json_object(sample, "$.score.value"), F.get_json_object(sample, "$.score"))
    return F.coalesce(raw.try_cast("double"), F.when(F.upper(raw).isin("C", "CORRECT", "TRUE", "1"), 1.0).otherwise(0.0))


def read_samples(spark: SparkSession, path: str, strata_keys: tuple[str, ...] = (), score_fn: Callable[[Column], Column] = default_score, threshold: float = 1.0, failure_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sample logs as episodes; ``score_fn`` and ``failure_fn`` map the sample's JSON text to a column.

    A log is one JSON document: a line of ``.jsonl``, anything else is a document a file.
    """
    packed = path.rstrip("/").endswith(".jsonl")
    logs = spark.read.text(path, wholetext=not packed)
    if packed:
        logs = logs.where(F.trim("value") != "")
    # The head is taken before the samples part, so that no sample carries its whole log.
    run = F.coalesce(F.get_json_object("value", "$.eval.run_id"), F.get_json_object("value", "$.eval.eval_id"), F.lit("run0"))
    heads = logs.select(run.alias("run_id"), F.coalesce(F.get_json_object("value", "$.eval.model"), F.lit("unknown")).alias("model"), F.get_json_object("value", "$.samples").alias("samples"))
    s = heads.select("run_id", "model", F.posexplode(F.from_json("samples", "array<variant>")).alias("place", "item")).withColumn("sample", F.to_json("item"))
    get = lambda p: F.get_json_object("sample", p)
    task = F.coalesce(get("$.id"), get("$.sample_id"), F.lit("task"))
    score = score_fn(F.col("sample"))
    error = get("$.error")
    df = s.select("place", "sample", task.alias("task"), score.alias("score"), ((score >= threshold) & error.isNull()).alias("success"), error.alias("_e"), "run_id", "model")
    is_map = F.substring("_e", 1, 1) == "{"
    mode = failure_fn(F.col("sample")) if failure_fn else F.when(is_map, F.coalesce(F.get_json_object("_e", "$.type"), F.lit("unlabeled"))).otherwise(F.lit("incorrect"))
    nth = F.row_number().over(Window.partitionBy("run_id", "task").orderBy("place")) - 1
    pairs = F.create_map(*(x for k in strata_keys for x in (F.lit(k), F.get_json_object("sample", f"$.metadata.{k}")))) if strata_keys else F.create_map().cast("map<string,string>")
    return df.select("run_id", "model", "task", F.coalesce(F.get_json_object("sample", "$.epoch").try_cast("int"), nth.cast("int")).alias("episode"), "score", "success", F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("strata"),
                     F.when(~F.col("success"), mode).alias("failure_mode"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("trajectory_ref"), F.to_json(F.struct(F.get_json_object("sample", "$.id").alias("sample_id"))).alias("meta"), F.col("place").cast("bigint").alias("ord"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, resolved) of a dict keyed by instance."""
    whole = spark.read.text(path, wholetext=True)
    table = F.from_json("value", "map<string,struct<resolved:boolean>>")
    checked = F.when(F.substring(F.trim("value"), 1, 1) == "{", table).otherwise(F.raise_error(F.lit("results must be an object")).cast("map<string,struct<resolved:boolean>>"))
    return whole.select(F.explode(checked).alias("instance_id", "r")).select("instance_id", F.coalesce("r.resolved", F.lit(False)).alias("resolved"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    raw = in_file_order(spark.read.text(path)).withColumnRenamed("place", "ord")
    return raw.select("ord", F.from_json("value", "struct<instance_id:string,model_name_or_path:string,trajectory:string>").alias("p")).select("ord", "p.*")


def read_benchmark(spark: SparkSession, predictions: str, results: str, agent: str = "shell-agent", run_id: str = "run0", trajectory_root: str | None = None, benchmark: str = "swebench") -> DataFrame:
    """Predictions with their results as episodes: a prediction without a result is unresolved, one without an id is skipped."""
    p = read_predictions(spark, predictions).where(F.coalesce("instance_id", F.lit("")) != "")
    both = p.join(read_results(spark, results), "instance_id", "left")
    ref = F.col("trajectory")
    if trajectory_root:
        ref = F.when(ref.startswith("/"), ref).otherwise(F.concat(F.lit(trajectory_root.rstrip("/") + "/"), ref))
    won = F.coalesce("resolved", F.lit(False))
    strata = F.create_map(F.lit("benchmark"), F.lit(benchmark), F.lit("domain"), F.lit("software-engineering"))
    both = row_numbers(both, ["ord"], "_nth")
    episode = F.col("_nth") - 1
    return both.select(F.lit(run_id).alias("run_id"), F.lit(agent).alias("model"), F.col("instance_id").alias("task"), episode.cast("int").alias("episode"), won.cast("double").alias("score"), won.alias("success"), strata.alias("strata"),
                       F.lit(None).cast("string").alias("failure_mode"), F.lit(None).cast("int").alias("length"), ref.alias("trajectory_ref"), F.to_json(F.struct(F.coalesce("model_name_or_path", F.lit("")).alias("model_name_or_path"))).alias("meta"), "ord")


def action_tool(action: Column) -> Column:
    """Canonical tool of an action, by itself or by its first word; anything else is a shell command."""
    table = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    low = F.trim(F.lower(action))
    return F.coalesce(table[low], table[F.element_at(F.split(low, r"\s+"), 1)], F.lit("run_shell_command"))


def read_benchmark_trajectories(spark: SparkSession, predictions: str, results: str, trajectory_root: str, agent: str = "shell-agent") -> DataFrame:
    """Features of every prediction's trajectory file that exists; ``write_before_read`` is always false here."""
    eps = read_benchmark(spark, predictions, results, agent, trajectory_root=trajectory_root).where(F.col("trajectory_ref").isNotNull())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(trajectory_root).select(F.regexp_replace("path", "^file:/*", "/").alias("trajectory_ref"), F.col("content").cast("string").alias("body"))
    rows = eps.select(F.col("task").alias("trial_id"), F.col("task").alias("task_path"), F.col("model").alias("agent_name"), "score", "trajectory_ref").join(files, "trajectory_ref")
    steps = F.from_json(F.coalesce(F.get_json_object("body", "$.steps"), F.get_json_object("body", "$.trajectory")), "array<struct<action:string>>")
    named = F.transform(steps, lambda s: F.coalesce(F.get_json_object(s["action"], "$.action"), s["action"], F.lit("")))
    df = rows.withColumn("tool_sequence", F.transform(named, action_tool)).where(F.col("tool_sequence").isNotNull()).drop("body")
    n = F.size("tool_sequence")
    count = lambda t: F.size(F.filter("tool_sequence", lambda x: x == t))
    first = lambda t: F.when(F.array_position("tool_sequence", t) > 0, F.array_position("tool_sequence", t) - 1).otherwise(n).cast("int")
    return df.withColumns({"n_steps": n, "n_tool_calls": n, "first_write_pos": first("write_file"), "first_exec_pos": first("run_shell_command"), "n_exec": count("run_shell_command"), "n_search": count("grep_search"), "n_reads": count("read_file"), "n_writes": count("write_file"),
                           "search_ratio": count("grep_search") / F.greatest(n, F.lit(1)), "write_before_read": F.lit(False), "tool_diversity": F.size(F.array_distinct("tool_sequence")) / F.greatest(n, F.lit(1)), "prefix_len": n, "is_prefix": F.lit(False)})
