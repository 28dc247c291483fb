"""Registered queries of sources and sinks: tables go out in a format and come back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeframe.catalog import _SEQ, CALLS, ORACLES, episodes, on_episodes, pool_records, register, rounded, sequences, sql
from episodeframe.catalog_plans import drained, plan_of, shared_path
from episodeframe.frame import Episodes
from episodeframe.operators import compare, trajectory
from episodeframe.plans import trainers
from episodeframe.schema import EPISODE, MEMORY, POOL
from episodeframe.sources import generic, job_source, jobs, logs, stores

_COLUMNS = ["run_id", "model", "task", "episode", "score", "success", "s_difficulty", "length", "failure_mode", "ord"]


def full_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode table in the canonical schema."""
    ep = episodes(spark, sf_dir).withColumn("strata", F.create_map(F.lit("difficulty"), F.col("s_difficulty")))
    return ep.select(*((F.col(f.name) if f.name in ep.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EPISODE))


@register("episodes_jsonl", f"SELECT {', '.join(_COLUMNS)} FROM ep")
def episodes_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "episodes")
    Episodes(full_episodes(spark, sf_dir)).write_jsonl(path)
    return generic.read_jsonl(spark, path).promote("difficulty").df.select(*_COLUMNS)


@register("episodes_parquet", f"SELECT {', '.join(_COLUMNS)} FROM ep")
def episodes_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "episodes")
    Episodes(full_episodes(spark, sf_dir)).write(path)
    return generic.read_parquet(spark, path).promote("difficulty").df.select(*_COLUMNS)


# Raw records: every 101st has no run, every 103rd a score out of range, every 107th one that is text; half leave success out.
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = episodes(spark, sf_dir)
    score = F.when(F.col("ord") % 107 == 0, F.lit('"high"')).when(F.col("ord") % 103 == 0, F.lit("1.5")).otherwise(F.col("score").cast("string"))
    rest = F.to_json(F.struct(F.when(F.col("ord") % 101 != 0, F.col("run_id")).alias("run_id"), "model", "task", "episode", F.when(F.col("ord") % 2 == 0, F.col("success")).alias("success"), F.col("s_difficulty").alias("difficulty"), "length"))
    return ep.withColumn("rest", rest).select("ord", F.concat(F.lit('{"score":'), score, F.lit(","), F.substring("rest", 2, 1 << 30)).alias("value"))


_VALID = "ord % 101 <> 0 AND ord % 103 <> 0 AND ord % 107 <> 0"


@register(
    "generic_records",
    f"g AS (SELECT *, CASE WHEN ord % 2 = 0 THEN success ELSE score >= 0.99 END AS won FROM ep WHERE {_VALID}) SELECT run_id, model, task, episode, score, won AS success, s_difficulty, length, CASE WHEN NOT won THEN 'below_threshold' END AS failure_mode FROM g",
)
def generic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON lines with absent fields and mistakes, read back: defaults filled in, invalid records left out."""
    path = f"{shared_path(spark, 'raw')}.jsonl"
    raw_records(spark, sf_dir).select("value").write.text(path)
    return generic.read_generic(spark, path, strict=False).promote("difficulty").df.select(*(c for c in _COLUMNS if c != "ord"))


@register(
    "invalid_records",
    "g AS (SELECT ord, list_filter([CASE WHEN ord % 101 = 0 THEN 'missing required field ''run_id''' END, CASE WHEN ord % 107 = 0 THEN 'field ''score'' must be a number' WHEN ord % 103 = 0 THEN 'field ''score'' must be between 0.0 and 1.0' END], lambda x: x IS NOT NULL) AS e FROM ep) "
    "SELECT array_to_string(e, '; ') AS errors, count(*)::BIGINT AS n FROM g WHERE len(e) > 0 GROUP BY 1",
)
def invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generic.convert(raw_records(spark, sf_dir), order="ord").where(F.size("errors") > 0)
    return found.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "rewards_jsonl",
    "SELECT round(CASE event_id % 4 WHEN 0 THEN user_id / 10.0::DOUBLE WHEN 1 THEN (user_id + 1) / 2.0::DOUBLE WHEN 2 THEN NULL ELSE user_id::DOUBLE END, 6) AS score, count(*)::BIGINT AS n FROM events GROUP BY 1",
    ep=False,
)
def rewards_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of events as numbers, maps of named ones, nulls, and maps that hold a null."""
    path = shared_path(spark, "rewards")
    u = F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 4 == 0, (F.col("user_id") / 10).cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a": '), u, F.lit(', "b": 1}'))).when(F.col("event_id") % 4 == 2, F.lit("null")).otherwise(F.concat(F.lit('{"a": '), u, F.lit(', "b": null}')))
    spark.read.parquet(f"{sf_dir}/events.parquet").select(line.alias("value")).write.text(path)
    return rounded(generic.read_rewards(spark, path).groupBy("score").agg(F.count(F.lit(1)).alias("n")))


@register(
    "sample_log",
    "SELECT concat('run_', user_id) AS run_id, concat('user_', user_id % 7) AS model, event_type AS task, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::INT AS episode, (event_id % 3 > 0)::INT::DOUBLE AS score, event_id % 3 > 0 AND event_id % 5 > 0 AS success, "
    "CASE WHEN event_id % 3 > 0 AND event_id % 5 > 0 THEN NULL WHEN event_id % 5 = 0 THEN 'limit' ELSE 'incorrect' END AS failure_mode FROM events",
    ep=False,
)
def sample_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log document for each user, a sample for each of its events; a document is a line, so files don't grow with the users."""
    path = f"{shared_path(spark, 'samples')}.jsonl"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sample = F.struct("event_id", F.col("event_type").alias("id"), F.when(F.col("event_id") % 3 > 0, "C").otherwise("I").alias("score"), F.when(F.col("event_id") % 5 == 0, F.struct(F.lit("limit").alias("type"))).alias("error"))
    logs_ = e.groupBy("user_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("run_"), F.col("user_id")).alias("run_id"), F.concat(F.lit("user_"), F.col("user_id") % 7).alias("model")).alias("eval"), "samples"))
    logs_.select(doc.alias("value")).write.text(path)
    read = logs.read_samples(spark, path)
    return read.select("run_id", "model", "task", "episode", "score", "success", "failure_mode")


@register(
    "benchmark_results",
    "SELECT concat('inst_', user_id) AS task, (row_number() OVER (ORDER BY user_id) - 1)::INT AS episode, (user_id % 3 = 0)::INT::DOUBLE AS score, user_id % 3 = 0 AS success, concat('/t/', user_id, '.traj') AS trajectory_ref FROM (SELECT DISTINCT user_id FROM events)",
    ep=False,
)
def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (a line each) with a results document that has every second instance."""
    path = shared_path(spark, "benchmark")
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    users.orderBy("user_id").select(F.concat(F.lit("inst_"), "user_id").alias("instance_id"), F.lit("m").alias("model_name_or_path"), F.concat("user_id", F.lit(".traj")).alias("trajectory")).write.json(f"{path}/predictions")
    known = users.where("user_id % 3 = 0 or user_id % 2 = 0").select(F.concat(F.lit('"inst_'), "user_id", F.lit('": {"resolved": '), (F.col("user_id") % 3 == 0).cast("string"), F.lit("}")).alias("value"), F.col("user_id").alias("place"))
    stores.write_document([("{", known)], "}", f"{path}/results")
    spark.read.text(f"{path}/results").coalesce(1).write.text(f"{path}/whole")
    return logs.read_benchmark(spark, f"{path}/predictions", f"{path}/whole", trajectory_root="/t").select("task", "episode", "score", "success", "trajectory_ref")


# A trial for each user.  Rewards stand in a map, a text, the result or nowhere; every fifth trial has no result.
def written_job(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "job")
    u, text = F.col("user_id"), F.col("score").cast("string")
    score = F.round(F.col("score"), 1)
    steps = F.transform("tool_sequence", lambda t: F.struct(F.array(F.struct(t.alias("function_name"))).alias("tool_calls")))
    result = F.struct(F.concat(F.lit("task_"), (u % 17).cast("string")).alias("task_name"), F.struct(F.concat(F.lit("user_"), (u % 7).cast("string")).alias("model")).alias("agent_info"), F.when(u % 4 == 2, score).alias("reward"))
    rows = sequences(spark, sf_dir).select(
        F.col("trial_id").alias("trial"), F.when(u % 5 != 0, F.to_json(result)).alias("result"), F.to_json(F.struct(F.struct(F.col("task_path").alias("path")).alias("task"), F.concat(F.lit("s"), (u % 3).cast("string")).alias("split"))).alias("config"),
        F.when(u % 4 == 0, F.concat(F.lit('{"a": '), text, F.lit(', "b": 1}'))).alias("reward_json"), F.when(u % 4 < 2, F.concat(text, F.lit("\n"))).alias("reward_txt"),
        F.to_json(F.struct(F.struct(F.lit("agent").alias("name")).alias("agent"), steps.alias("steps"))).alias("trajectory"),
    )
    job_source.write_job(rows, path)
    return path


_JOB = (
    "WITH u AS (SELECT DISTINCT user_id AS u, concat('trial_', user_id) AS trial, user_id % 11 / 10.0::DOUBLE AS s FROM events), r AS (SELECT *, CASE u % 4 WHEN 0 THEN (s + 1) / 2 WHEN 3 THEN NULL ELSE s END AS reward FROM u WHERE u % 5 <> 0) "
    "SELECT 'job0' AS run_id, concat('user_', u % 7) AS model, concat('task_', u % 17) AS task, {episode}round(coalesce(reward, 0), 6) AS score, coalesce(reward >= 0.99, false) AS success, concat('s', u % 3) AS split, "
    "CASE WHEN reward IS NULL THEN 'missing_reward' WHEN reward < 0.99 THEN 'below_threshold' END AS failure_mode FROM r"
)


@register("job_folders", _JOB.format(episode="(row_number() OVER (PARTITION BY u % 17 ORDER BY trial) - 1)::INT AS episode, "), ep=False)
def job_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job folder written by its sink and read as episodes."""
    found = jobs.read_jobs(spark, [written_job(spark, sf_dir)], strata_from_config=("split",))
    return rounded(found.select("run_id", "model", "task", "episode", "score", "success", F.col("strata")["split"].alias("split"), "failure_mode"))


@register("stream_job_folders", _JOB.format(episode=""), ep=False)
def stream_job_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder as a stream of ended trials."""
    stream = jobs.stream_jobs(spark, [written_job(spark, sf_dir)], settle=0.0, strata_from_config=("split",))
    found = drained(stream, "ended")
    return rounded(found.select("run_id", "model", "task", "score", "success", F.col("strata")["split"].alias("split"), "failure_mode"))


@register(
    "trial_trajectories",
    f"{_SEQ} SELECT trial_id, task_path, 'agent' AS agent_name, round(score, 6) AS score, array_to_string(seq, ' ') AS tools, len(seq)::INT AS prefix_len FROM s WHERE user_id % 4 < 2",
    ep=False,
)
def trial_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the trials that have a reward text."""
    found = jobs.read_trajectory_dirs(spark, [written_job(spark, sf_dir)])
    return rounded(found.select("trial_id", "task_path", "agent_name", "score", F.array_join("tool_sequence", " ").alias("tools"), "prefix_len"))


@register("memories_jsonl", f"{_SEQ} SELECT trial_id, task_path, score, array_to_string(seq, ' ') AS tools FROM s", ep=False)
def memories_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "memories")
    rows = trajectory.features(sequences(spark, sf_dir))
    stores.write_memories(rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORY)), path)
    return stores.read_memories(spark, path).select("trial_id", "task_path", "score", F.array_join("tool_sequence", " ").alias("tools"))


@register("pool_document", "SELECT concat('agent_', model) AS agent_name, task, score, success FROM ep")
def pool_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "pool")
    p = pool_records(spark, sf_dir).withColumn("model_name", F.col("agent_name"))
    stores.write_pool(p.select(*((F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POOL)), path)
    return stores.read_pool(spark, path).select("agent_name", "task", "score", "success")


@register("plan_document", ORACLES["curriculum_order"], ep=False)
def plan_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, plan = shared_path(spark, "plan"), plan_of(episodes(spark, sf_dir))
    stores.write_plan(plan, path)
    return rounded(stores.read_plan(spark, path, plan.schema).select("task", "priority", "position"))


@register("preference_jsonl", ORACLES["preference_examples"], ep=False)
def preference_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = trainers.write_examples(plan_of(episodes(spark, sf_dir)), shared_path(spark, "examples"))
    return rounded(spark.read.json(path).select("task", "chosen", "rejected", "chosen_score", "rejected_score"))


@register(
    "normalize_tools",
    "SELECT tool, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 8 = 7 THEN 'unknown' WHEN event_type IN ('view', 'click') THEN CASE WHEN event_type = 'view' THEN 'read_file' ELSE 'list_directory' END WHEN event_type = 'signup' THEN 'search_tool' WHEN event_type = 'purchase' THEN 'write_file' ELSE 'run_shell_command' END AS tool FROM events) GROUP BY tool",
    ep=False,
)
def normalize_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools by the names that agents use for them, some in other case or with blanks, some empty."""
    named = calls_by_other_names(spark, sf_dir)
    raw = F.when(F.col("event_id") % 8 == 7, "").when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.col("name"))
    return named.groupBy(trajectory.normalize(raw).alias("tool")).agg(F.count(F.lit(1)).alias("n"))


def calls_by_other_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in (("view", "view"), ("click", "list_dir"), ("signup", "GrepSearch"), ("purchase", "apply_edit"), ("error", "Bash")) for x in pair))
    return sql(spark, sf_dir, "select * from {events}").select("event_id", "ts", "user_id", F.coalesce(names[F.col("event_type")], F.lit("Bash")).alias("name"))


@register("tool_sequences", f"{CALLS} SELECT trial_id, string_agg(tool, ' ' ORDER BY ts, event_id) AS tools FROM calls GROUP BY trial_id", ep=False)
def tool_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with one call each, half of them by the call's other name field, and a nameless call after each."""
    call = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("name")).alias("function_name"), F.when(F.col("event_id") % 2 == 1, F.col("name")).alias("tool_use_name"), F.lit("{}").alias("arguments"), F.col("event_id").cast("string").alias("tool_call_id"))
    none = F.struct(F.lit("").alias("function_name"), F.lit(None).cast("string").alias("tool_use_name"), F.lit("").alias("arguments"), F.lit("").alias("tool_call_id"))
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.array(call, none).alias("tool_calls"))))
    rows = calls_by_other_names(spark, sf_dir).groupBy(F.concat(F.lit("trial_"), F.col("user_id").cast("string")).alias("trial_id")).agg(F.transform(steps, lambda s: F.struct(s["tool_calls"].alias("tool_calls"))).alias("steps"))
    return rows.select("trial_id", F.array_join(trajectory.tool_sequence(), " ").alias("tools"))


on_episodes(
    "power_table",
    "m AS (SELECT model, count(*) AS n, avg(score) AS mean, var_samp(score) AS v FROM ep GROUP BY model), c AS (SELECT n AS cn, mean AS cm, v AS cv FROM m WHERE model = 'AF'), "
    "e AS (SELECT model, n, cn, abs(mean - cm) / sqrt(((n - 1) * v + (cn - 1) * cv) / (n + cn - 2)) AS d FROM m, c WHERE model <> 'AF') "
    "SELECT model, n::BIGINT AS n, round(2.8015852181129683 * sqrt(1.0 / n + 1.0 / cn), 6) AS min_effect, round(d, 6) AS effect, ceil(2 * 2.8015852181129683 * 2.8015852181129683 / (d * d))::BIGINT AS required_n FROM e",
)(lambda ep: compare.power_table(ep, "AF"))
