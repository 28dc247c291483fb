"""Registered queries of plans, simulation, control, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeframe import lineage, sqlreg
from episodeframe.catalog import _FEATURES, _PREFIX, _PROFILE, CALLS, ORACLES, calls, episodes, on_episodes, on_pool, register, rounded, sequences
from episodeframe.operators import pool, taxonomy, trajectory
from episodeframe.plans import control, curriculum, cycle, environments, recursion, simulation
from episodeframe.streaming import monitor, tables, trials


def one(ep: DataFrame) -> DataFrame:
    return ep.where(F.col("model") == "AF")


def runs_of(ep: DataFrame) -> DataFrame:
    """Episodes as trajectory runs with paths."""
    path = F.concat(F.lit("runs/"), F.col("task"), F.lit("/"), F.col("run_id"), F.lit("-"), F.lpad(F.col("episode").cast("string"), 3, "0"))
    return ep.select(F.concat(F.lit("tasks/"), F.col("task")).alias("task_path"), "score", path.alias("traj_path"))


_AF = f"{_PROFILE}, p AS (SELECT * FROM profile WHERE model = 'AF'), e AS (SELECT *, concat('runs/', task, '/', run_id, '-', lpad(episode::VARCHAR, 3, '0')) AS traj_path FROM ep WHERE model = 'AF')"
_PAIRS = f"{_AF}, h AS (SELECT e.task, max({{'s': e.score, 'p': traj_path}}) AS h FROM e JOIN p USING (task) WHERE kind = 'recoverable' AND e.score >= 0.9 * q_star GROUP BY e.task)"
on_episodes(
    "training_pairs",
    f"{_PAIRS} SELECT task, h.p AS reinforce_path, traj_path AS contrast_path, round(h.s, 6) AS reinforce_score, round(e.score, 6) AS contrast_score, round(h.s - e.score, 6) AS pair_gap FROM e JOIN h USING (task) JOIN p USING (task) WHERE e.score < 0.9 * q_star",
)(lambda ep: curriculum.training_pairs(runs_of(one(ep)), taxonomy.task_profiles(one(ep))))
on_episodes(
    "preference_examples",
    f"{_PAIRS} SELECT task, h.p AS chosen, traj_path AS rejected, round(h.s, 6) AS chosen_score, round(e.score, 6) AS rejected_score FROM e JOIN h USING (task) JOIN p USING (task) WHERE e.score < 0.9 * q_star",
)(lambda ep: curriculum.preference_examples(plan_of(ep)))


def plan_of(ep: DataFrame) -> DataFrame:
    profiles = taxonomy.task_profiles(one(ep))
    return curriculum.build_plan(profiles, curriculum.training_pairs(runs_of(one(ep)), profiles))


on_episodes("curriculum_order", f"{_AF} SELECT task, round(gap * (1 - consistency), 6) AS priority, row_number() OVER (ORDER BY round(gap * (1 - consistency), 9) DESC, task)::INT AS position FROM p WHERE kind = 'recoverable'")(lambda ep: plan_of(ep).select("task", "priority", "position"))
on_episodes("simulated_training", f"{_AF} SELECT task, round(least(1.0, q_star + round_even(0.4 * gap * consistency, 4)), 3) AS score FROM p WHERE kind = 'recoverable'")(lambda ep: curriculum.simulated_training(plan_of(ep)).select("task", F.round("score", 3).alias("score")))
on_episodes(
    "recommendations",
    f"{_PAIRS}, tp AS (SELECT task, count(*) AS n, any_value(h.s) AS r, min(e.score) AS c FROM e JOIN h USING (task) JOIN p USING (task) WHERE e.score < 0.9 * q_star GROUP BY task) "
    "SELECT task, CASE WHEN n IS NULL THEN concat(task, ' has no pair of runs yet: run it more often.') ELSE printf('Train on %d pair(s): reinforce %.2f against %.2f, a gap of %.2f.', n, r, c, r - c) END AS recommendation FROM p LEFT JOIN tp USING (task) WHERE kind = 'recoverable'",
)(lambda ep: plan_of(ep).select("task", "recommendation"))
on_episodes("plan_summary", f"{_AF} SELECT 'AF' AS model, count(*) FILTER (kind = 'recoverable')::BIGINT AS n_recoverable, count(*) FILTER (kind = 'recoverable')::BIGINT AS n_planned, count(*) FILTER (kind = 'recoverable') = 0 AS cycle_complete FROM p")(
    lambda ep: curriculum.plan_summary(plan_of(ep), taxonomy.right_tail(taxonomy.task_profiles(one(ep)))).select("model", "n_recoverable", "n_planned", "cycle_complete")
)
on_episodes("accumulate", "a AS (SELECT task, min(score) AS s FROM ep WHERE run_id = 'run_1995' GROUP BY task), b AS (SELECT task, max(score) AS s FROM ep WHERE run_id = 'run_1996' GROUP BY task) SELECT task, round(s, 6) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE task NOT IN (SELECT task FROM a))")(
    lambda ep: curriculum.accumulate(ep.where("run_id = 'run_1995'").groupBy("task").agg(F.min("score").alias("s")), ep.where("run_id = 'run_1996'").groupBy("task").agg(F.max("score").alias("s")), ["task"])
)

on_episodes(
    "cycle_overview",
    "g AS (SELECT task, max(score) AS q, avg(score) AS b FROM ep GROUP BY task), k AS (SELECT *, CASE WHEN q = 0 THEN 'stuck' WHEN q - b < 1e-9 THEN 'solid' ELSE 'recoverable' END AS kind FROM g) "
    "SELECT count(*)::BIGINT AS n_tasks, count(*) FILTER (kind = 'solid')::BIGINT AS n_solid, count(*) FILTER (kind = 'recoverable')::BIGINT AS n_recoverable, count(*) FILTER (kind = 'stuck')::BIGINT AS n_stuck, count(*) FILTER (kind = 'recoverable')::BIGINT AS n_planned, "
    "count(*) FILTER (kind = 'recoverable') = 0 AS cycle_complete, round(sum(b) / sum(q), 6) AS consistency_index, round(sum(q) - sum(b), 6) AS recoverable_score_left FROM k",
)(lambda ep: cycle.run_cycle(ep).overview.select("n_tasks", "n_solid", "n_recoverable", "n_stuck", "n_planned", "cycle_complete", "consistency_index", "recoverable_score_left"))

# --------------------------------------------------------------- simulation
_BEST = "b AS (SELECT task, max(score) AS best FROM e GROUP BY task)"
on_episodes("select_right_tail", f"{_AF}, {_BEST} SELECT task, run_id, episode, round(score, 6) AS score FROM e JOIN p USING (task) JOIN b USING (task) WHERE kind = 'recoverable' ORDER BY round(gap, 9) DESC, task, (score < 0.9 * best)::INT, ord LIMIT 40")(
    lambda ep: simulation.select_right_tail(one(ep), taxonomy.task_profiles(one(ep)).withColumn("gap", F.round("gap", 9)), 40).select("task", "run_id", "episode", "score")
)
on_episodes("select_mean_reward", "SELECT score, count(*)::BIGINT AS n FROM (SELECT round(score, 6) AS score FROM ep ORDER BY ep.score DESC, ord LIMIT 4000) GROUP BY ALL")(lambda ep: simulation.select_mean_reward(ep, 4000).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
on_episodes(
    "training_effect",
    f"{_AF}, sel AS (SELECT task, avg(score) AS sm, max(score) AS sx, min(score) AS sn FROM e WHERE length > 20 GROUP BY task), "
    "gn AS (SELECT p.task, CASE kind WHEN 'recoverable' THEN CASE WHEN sx >= 0.9 * q_star AND sn < 0.9 * q_star THEN 0.6 * q_star * (1 - q_bar) ELSE 0.4 * sm * (1 - q_bar) END WHEN 'stuck' THEN 0.04 * sm ELSE 0 END AS gain FROM p LEFT JOIN sel USING (task)) "
    "SELECT task, round(avg(least(1.0, score + coalesce(gain, 0))), 9) AS new_mean FROM e JOIN gn USING (task) GROUP BY task", places=9)(lambda ep: simulation.apply_training_effect(one(ep), one(ep).where("length > 20"), taxonomy.task_profiles(one(ep)), "right_tail").groupBy("task").agg(F.avg("new_score").alias("new_mean")))
on_episodes("overoptimized_gain", f"{_AF} SELECT task, t, round(round(gap + 1e-9, 4) * greatest(0, least(1, 0.6 * t - 0.15 * t * t)), 6) AS gain FROM p, (SELECT unnest([1.0::DOUBLE, 2.0, 5.0]) AS t)")(
    lambda ep: taxonomy.task_profiles(one(ep)).select("task", F.round(F.col("gap") + 1e-9, 4).alias("gap"), F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))).alias("t")).select("task", "t", simulation.overoptimized_gain(F.col("gap"), F.col("t")).alias("gain"))
)
on_episodes("simulated_gains")(lambda ep: simulation.strategy_results(simulation.simulate_gains(one(ep), 5000)))
on_episodes("simulated_rounds")(lambda ep: simulation.strategy_results(simulation.simulate_rounds(one(ep), 1000), "rounds"))


# ------------------------------------------------------------------ control
# A task chosen j times before has 0.6 ** j of its first distance to 1 left.
@register(
    "mpc_sequences",
    "WITH s AS (SELECT id, t, (id // (3 ** (3 - t))::BIGINT) % 3 AS a FROM range(81) r(id), range(4) h(t)), c AS (SELECT *, count(*) OVER (PARTITION BY id, a ORDER BY t) - 1 AS j FROM s) "
    "SELECT id, round(sum(power(0.99, t) * 0.4 * g * u * power(0.6, j)), 6) AS value FROM c JOIN (VALUES (0, 0.4::DOUBLE, 0.5::DOUBLE), (1, 0.1, 0.8), (2, 0.25, 0.2)) w(a, g, u) USING (a) GROUP BY id",
    ep=False,
)
def mpc_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = [control.CurriculumTask(f"t{i}", g) for i, g in enumerate((0.4, 0.1, 0.25))]
    return rounded(control.MPCCurriculumPlanner(spark, tasks, horizon=4).sequences([0.5, 0.2, 0.8]).select("id", "value"))


@register("curriculum_values")
def curriculum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = [control.CurriculumTask("t1", 0.4), control.CurriculumTask("t2", 0.1)]
    plan = control.CurriculumValueIterator(tasks).plan([0.5, 0.5], 4)
    return spark.createDataFrame(list(enumerate(plan)), "step int, task string")


_LIN = "x AS (SELECT task, avg(score) AS a, avg(length) / 50.0 AS b, avg(success::INT) AS r FROM ep GROUP BY task)"


@on_episodes("bandit_posterior", f"{_LIN}, s AS (SELECT 1 + sum(a * a) / 0.0025 AS p, sum(a * b) / 0.0025 AS q, 1 + sum(b * b) / 0.0025 AS w, sum(a * r) / 0.0025 AS u, sum(b * r) / 0.0025 AS v FROM x) SELECT round((w * u - q * v) / (p * w - q * q), 6) AS a, round((p * v - q * u) / (p * w - q * q), 6) AS b FROM s")
def bandit_posterior(ep):
    x = ep.groupBy("task").agg(F.avg("score").alias("a"), (F.avg("length") / 50.0).alias("b"), F.avg(F.col("success").cast("int")).alias("r"))
    bandit = control.ThompsonSamplingScheduler(2)
    bandit.update_from(x, ["a", "b"], "r")
    return ep.sparkSession.createDataFrame([tuple(map(float, bandit.mu))], "a double, b double")


# ---------------------------------------------------------------- recursion
def found_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries that the fitted predictor and the phase changes give, of the best run of each task."""
    predictor = trajectory.fit_predictor(trajectory.features(sequences(spark, sf_dir)))
    pre = trajectory.check(trajectory.prefix_features(calls(spark, sf_dir), "trial_id", ["ts", "event_id"]).withColumn("n_steps", F.col("prefix_len")), predictor)
    b = trajectory.phase_boundaries(pre, "trial_id")
    runs = sequences(spark, sf_dir).select(F.concat(F.lit("task_"), (F.col("user_id") % 200).cast("string")).alias("task"), "trial_id", "score", F.col("user_id").alias("ord"))
    return recursion.structural_boundaries(runs, b.withColumn("prefix_len", F.col("prefix_len").cast("int")))


def scored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of one agent (a decomposition is made for one), with the scores of its attempts."""
    ep = one(episodes(spark, sf_dir))
    return taxonomy.with_scores(taxonomy.task_profiles(ep), ep)


@register("sub_tasks")
def sub_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = scored_profiles(spark, sf_dir)
    subs = recursion.decompose(profiles, found_of(spark, sf_dir))
    return rounded(subs.drop("scores", "condition_source"))


@register("recursive_gaps")
def recursive_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = scored_profiles(spark, sf_dir)
    return rounded(recursion.recursive_gaps(recursion.decompose(profiles, found_of(spark, sf_dir))))


@register("environments")
def generated_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = scored_profiles(spark, sf_dir)
    envs = environments.generate(recursion.decompose(profiles, found_of(spark, sf_dir)))
    return environments.Registry(envs).active().select("task_id", "parent_task", "phase_tag", F.to_json("reward").alias("reward"))


_VOTES = "select concat('task-', cast(user_id % 5 as varchar(5))) as parent_task, tool as phase_tag, cast(event_id % 30 as int) as entry_step, cast(event_id % 30 + 3 as int) as exit_step, trial_id as agent_name, cast(0.5 as double) as confidence, '' as source from {calls}"
register(
    "consensus",
    f"{CALLS.replace('WITH', 'WITH RECURSIVE', 1)}, v AS (SELECT concat('task-', (user_id % 5)::VARCHAR) AS parent_task, tool AS phase_tag, (event_id % 30)::INT AS en, (event_id % 30 + 3)::INT AS ex FROM calls), st AS (SELECT DISTINCT parent_task, phase_tag, en FROM v), "
    "l AS (SELECT parent_task, phase_tag, min(en) AS en FROM st GROUP BY ALL UNION ALL SELECT l.parent_task, l.phase_tag, min(st.en) FROM l JOIN st ON st.parent_task = l.parent_task AND st.phase_tag = l.phase_tag AND st.en > l.en + 4 GROUP BY 1, 2), "
    "led AS (SELECT v.*, l.en AS lead FROM v ASOF JOIN l ON v.parent_task = l.parent_task AND v.phase_tag = l.phase_tag AND v.en >= l.en) "
    "SELECT parent_task, phase_tag, quantile_disc(en, 0.5)::INT AS entry_step, quantile_disc(ex, 0.5)::INT AS exit_step, count(*)::BIGINT AS n_votes, count(*) * 0.5::DOUBLE AS total_confidence, 0.5::DOUBLE AS mean_confidence FROM led GROUP BY parent_task, phase_tag, lead HAVING count(*) >= 2",
    ep=False,
)(lambda spark, sf_dir: rounded(pool.consensus(spark.sql(_VOTES, calls=calls(spark, sf_dir)), tolerance=4).drop("agents")))
register(
    "boundary_variants",
    f"{CALLS}, v AS (SELECT trial_id AS agent_name, tool AS phase_tag, (event_id % 30)::INT AS entry_step, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 30 + 3)::INT END AS exit_step FROM calls) SELECT agent_name, phase_tag, entry_step, CASE WHEN exit_step = 0 THEN entry_step ELSE exit_step END AS exit_step, 0.5::DOUBLE AS confidence FROM v",
    ep=False,
)(lambda spark, sf_dir: _variants(calls(spark, sf_dir)))


def _variants(c: DataFrame) -> DataFrame:
    sub = F.struct(
        F.lit("p").alias("parent_task"), F.col("tool").alias("phase_tag"), (F.col("event_id") % 30).cast("int").alias("entry_step"), F.when(F.col("event_id") % 3 == 0, 0).otherwise((F.col("event_id") % 30 + 3).cast("int")).alias("exit_step"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source")
    )
    graphs = c.groupBy(F.col("trial_id").alias("agent_name")).agg(F.collect_list(sub).alias("sub_tasks"))
    return pool.variants(graphs).select("agent_name", "phase_tag", "entry_step", "exit_step", "confidence")


# ------------------------------------------------------------------ streams
@register("stream_prefixes", f"{CALLS} SELECT trial_id, max(k)::INT AS prefix_len, sum(k)::BIGINT AS total FROM (SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY ts, event_id) AS k FROM calls) GROUP BY trial_id", ep=False)
def stream_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor as a stream over the event file, run to its end and counted by trial."""
    found = drained(monitor.stream_prefixes(call_stream(spark, sf_dir)), "prefixes")
    return found.groupBy("trial_id").agg(F.max("prefix_len").alias("prefix_len"), F.sum("prefix_len").alias("total"))


def drained(stream: DataFrame, label: str) -> DataFrame:
    """What a stream has written when its source is read to the end: files in the shared folder."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def shared_path(spark: SparkSession, label: str) -> str:
    lineage.shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}_{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def call_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of tools, as they come."""
    kind = F.col("event_type")
    tool = F.when(kind == "view", "read_file").when(kind == "click", "list_directory").when(kind == "signup", "search_tool").when(kind == "purchase", "write_file").otherwise("run_shell_command")
    return event_stream(spark, sf_dir).select(F.concat(F.lit("trial_"), F.col("user_id").cast("string")).alias("trial_id"), "ts", "event_id", tool.alias("tool"))


@register(
    "stream_confidence",
    "WITH m AS (SELECT event_type AS task, count(*) AS t, avg(event_id % 11 / 10.0::DOUBLE) AS mean FROM events GROUP BY 1), r AS (SELECT *, sqrt(ln(2 / ((1 - 0.95::DOUBLE) * 6 / (pi() * pi() * t * t))) / (2 * t)) AS radius FROM m) "
    "SELECT task, t, round(mean, 6) AS running_mean, round(greatest(0, mean - radius), 6) AS running_lo, round(least(1, mean + radius), 6) AS running_hi FROM r",
    ep=False,
)
def stream_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the running mean of each kind of event, as they stand when the stream has ended."""
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("task"), "ts", (F.col("event_id") % 11 / 10.0).alias("score"))
    found = drained(monitor.stream_confidence(rows), "confidence")
    last = found.groupBy("task").agg(F.max("t").alias("t"), F.max_by(F.struct("running_mean", "running_lo", "running_hi"), "t").alias("b"))
    return rounded(last.select("task", "t", "b.running_mean", "b.running_lo", "b.running_hi"))


_COUNTED = ("n_reads", "n_writes", "n_exec", "n_search", "first_write_pos", "first_exec_pos", "search_ratio", "tool_diversity", "write_before_read")


# Trials that a day's pause ends; the watermark stands ten minutes before the last event, in whole milliseconds.
_TRIALS = (
    CALLS.replace("calls AS", "every AS", 1) + ", w AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 AS passed FROM every), t AS (SELECT e.*, epoch_us(ts) AS us FROM every e, w WHERE epoch_us(ts) <= passed), "
    "g AS (SELECT *, coalesce(us - lag(us) OVER o > 86400000000, false) AS new FROM t WINDOW o AS (PARTITION BY trial_id ORDER BY ts, event_id)), "
    "calls AS (SELECT event_id, ts, us, tool, concat(trial_id, '/', sum(new::INT) OVER (PARTITION BY trial_id ORDER BY ts, event_id)) AS trial_id FROM g), " + _PREFIX + ", "
    "b AS (SELECT trial_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, max(us) AS last, count(*) AS n FROM calls GROUP BY 1), "
    "z AS (SELECT trial_id, split_part(trial_id, '/', 1) AS who, split_part(trial_id, '/', 2)::INT AS s, last + 86400000000 <= passed AS idle FROM b, w), "
    "d AS (SELECT trial_id FROM z WHERE idle OR EXISTS (SELECT 1 FROM z y WHERE y.who = z.who AND y.s > z.s)), "
    "o AS (SELECT f.*, false AS ended FROM f UNION ALL SELECT f.*, true FROM f JOIN b ON f.trial_id = b.trial_id AND f.k = b.n WHERE f.trial_id IN (SELECT trial_id FROM d)) "
    "SELECT split_part(trial_id, '/', 1) AS trial_id, CASE WHEN NOT ended THEN event_id END AS event_id, began, k::INT AS prefix_len, " + _FEATURES.replace("::BIGINT", "::INT") + ", ended FROM o JOIN b USING (trial_id)"
)


@register("stream_trials", _TRIALS, ep=False)
def stream_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes in event order and the ends of idle trials, as far as the watermark went."""
    with trials.state_store(spark):
        found = drained(trials.stream_trials(call_stream(spark, sf_dir), idle="1 day"), "trials")
    return rounded(found.select("trial_id", "event_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("began"), "prefix_len", *_COUNTED, "ended"))


@register(
    "stream_memories",
    "WITH e AS (SELECT concat('tasks/task-', (user_id % 17)::VARCHAR) AS task_path, concat('trial_', user_id::VARCHAR) AS trial_id, event_id % 11 / 10.0::DOUBLE AS score, event_id AS ord FROM events), "
    "l AS (SELECT task_path, trial_id, arg_max(score, ord) AS score, max(ord) AS ord FROM e GROUP BY 1, 2), m AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS outcome_class, bool_or(score < 0.5) OVER (PARTITION BY task_path) AS low FROM l) "
    "SELECT task_path, trial_id, score, ord, outcome_class, outcome_class = 'high' AND low AS is_recoverable_high FROM m",
    ep=False,
)
def stream_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of trials, upserted by a stream: the last outcome of each trial stays."""
    rows = event_stream(spark, sf_dir).select(F.concat(F.lit("tasks/task-"), (F.col("user_id") % 17).cast("string")).alias("task_path"), F.concat(F.lit("trial_"), F.col("user_id").cast("string")).alias("trial_id"), (F.col("event_id") % 11 / 10.0).alias("score"), F.col("event_id").alias("ord"))
    path = shared_path(spark, "memories")
    table = tables.MemoryTable(spark, path)
    table.stream(rows, f"{path}-log", availableNow=True).awaitTermination()
    return table.read().select("task_path", "trial_id", "score", "ord", "outcome_class", "is_recoverable_high")


@register("stream_cycle_log", ORACLES["kappa_changes"], ep=False)
def stream_cycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of each model as improvement cycles, logged by a stream."""
    path = shared_path(spark, "cycles")
    kappa = episodes(spark, sf_dir).groupBy("model", F.substring("run_id", 5, 4).cast("bigint").alias("cycle")).agg(F.avg("score").alias("kappa"))
    kappa.write.parquet(path)
    log = drained(tables.stream_cycle_log(spark.readStream.schema(kappa.schema).parquet(path), "model"), "log")
    return rounded(log.select("model", F.col("cycle").cast("int").alias("cycle"), "kappa", "delta", "plateaued"))


# ------------------------------------------------------------ SQL alone
def in_sql(name: str, oracle: str, text: str, ep: bool = True) -> None:
    """A query written in SQL only, over the session's functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sqlreg.register(spark)
        frames = {"ep": episodes(spark, sf_dir)} if ep else {"calls": calls(spark, sf_dir)}
        return rounded(spark.sql(text, **frames))

    register(name, oracle, ep=False)(run)


in_sql("sql_iqm", ORACLES["iqm_by_difficulty"], "SELECT s_difficulty, iqm(score, n) AS iqm FROM (SELECT s_difficulty, score, count(*) AS n FROM {ep} GROUP BY ALL) GROUP BY s_difficulty")
in_sql("sql_cvar", ORACLES["cvar_by_difficulty"], "SELECT s_difficulty, cvar(score, n, double(0.1)) AS cvar FROM (SELECT s_difficulty, score, count(*) AS n FROM {ep} GROUP BY ALL) GROUP BY s_difficulty")
in_sql("sql_entropy", ORACLES["outcome_entropy"], "SELECT model, task, outcome_entropy(score, n) AS outcome_entropy FROM (SELECT model, task, score, count(*) AS n FROM {ep} GROUP BY ALL) GROUP BY model, task")
in_sql("sql_prefixes", ORACLES["prefix_features"], "SELECT * FROM tool_prefixes(TABLE(SELECT trial_id, event_id, ts, tool FROM {calls}) PARTITION BY trial_id ORDER BY (ts, event_id))", ep=False)


on_pool(
    "pool_weighted_pairs",
    ", g AS (SELECT task, count(*) AS n, arg_max({'agent_name': agent_name, 'score': score}, (score, -ord)) AS p, arg_min({'agent_name': agent_name, 'score': score}, (score, ord)) AS m FROM pool GROUP BY task) "
    "SELECT task, round(p.score - m.score, 6) AS gap, concat(p.agent_name, ' succeeds on ', CASE WHEN least(p.score, 0.5) > least(m.score, 0.5) THEN 'ck0, ck1' ELSE 'ck0' END, ' where ', m.agent_name, ' fails') AS attribution FROM g WHERE n >= 2 AND p.score - m.score >= 0.1",
)(lambda p: pool.cross_agent_pairs(p, require_checkpoints=True).select("task", "gap", "attribution"))
