"""Registered queries over the driver's tables, each with its DuckDB SQL.

The episode table is a deterministic projection of ``lineitem`` and ``part``,
the same SQL text in both engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeframe.functions import special
from episodeframe.operators import compare, failure, inference, metrics, pool, retrieval, taxonomy, trajectory, windows

EPISODES_SQL = """
select run_id, model, task, cast(episode as int) as episode, score, success, s_difficulty, length,
       case when success then null when score < 0.3 then 'timeout' when score < 0.5 then null else 'crash' end as failure_mode,
       cast(substr(run_id, 5) as bigint) * 1000000 + episode as ord
from (
  select concat('run_', cast(year(l_shipdate) as varchar(10))) as run_id,
         concat(l_returnflag, l_linestatus) as model,
         concat('task_', cast(l_partkey % 200 as varchar(10))) as task,
         row_number() over (partition by year(l_shipdate), l_returnflag, l_linestatus, l_partkey % 200
           order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity, l_tax) - 1 as episode,
         case when l_partkey % 10 = 0 then cast(0.0 as double) when l_partkey % 10 = 1 then cast(1.0 as double)
              else cast(round(l_discount * 10, 1) as double) end as score,
         case when l_partkey % 10 = 0 then false when l_partkey % 10 = 1 then true else round(l_discount * 10, 1) >= 0.8 end as success,
         case when p_size <= 16 then 'easy' when p_size <= 33 then 'medium' else 'hard' end as s_difficulty,
         cast(l_quantity as int) as length
  from {lineitem} join {part} on l_partkey = p_partkey)
"""

# One row for each event: the tools of a user's trajectory.
CALLS_SQL = """
select concat('trial_', cast(user_id as varchar(20))) as trial_id, user_id, ts, event_id,
       case event_type when 'view' then 'read_file' when 'click' then 'list_directory' when 'signup' then 'search_tool'
            when 'purchase' then 'write_file' else 'run_shell_command' end as tool
from {events}
"""

POOL_SQL = """
select concat('agent_', model) as agent_name, task, score, ord + case model when 'AF' then 0 when 'AO' then 1 when 'NF' then 2 when 'NO' then 3 when 'RF' then 4 else 5 end * cast(10000000000 as bigint) as ord, success
from ep
"""


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """``{table}`` in the text is a table of ``sf_dir``."""
    names = [t for t in ("lineitem", "part", "events", "orders", "customer", "documents", "labels", "embeddings", "conversations") if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}, **frames)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, EPISODES_SQL)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CALLS_SQL)


def pool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sql(spark, sf_dir, POOL_SQL.replace("from ep", "from {ep}"), ep=episodes(spark, sf_dir))
    return df.withColumns({"trajectory_ref": F.lit(None).cast("string"), "checkpoint_scores": F.create_map(F.lit("ck0"), F.col("score"), F.lit("ck1"), F.least(F.col("score"), F.lit(0.5)))})


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(n), places).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(text: str) -> str:
    for t in ("lineitem", "part", "events", "orders", "customer", "documents", "labels", "embeddings", "conversations"):
        text = text.replace("{" + t + "}", t)
    return text


EP = "WITH ep AS (" + _plain(EPISODES_SQL) + ")"
CALLS = "WITH calls AS (" + _plain(CALLS_SQL) + ")"


def register(name: str, oracle: str | None = None, ep: bool = True):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            # An oracle over episodes goes on with further CTEs or with its SELECT.
            text = oracle.strip()
            ORACLES[name] = text if not ep else EP + ("\n" if text.startswith("SELECT") else ", ") + text
        return f

    return add


def on_episodes(name: str, oracle: str | None = None, places: int = 6):
    """Registers f(episodes) -> DataFrame; more places where values may lie halfway between two of six."""

    def add(f):
        register(name, oracle)(lambda spark, sf_dir: rounded(f(episodes(spark, sf_dir)), places))
        return f

    return add



def A():
    return F.col("model") == "AF"


def B():
    return F.col("model") == "RF"


# ---------------------------------------------------------- aggregates A1-A37
def _pass_at(k: int) -> str:
    factors = " * ".join(f"((n - c - {i}) / (n - {i})::DOUBLE)" for i in range(k)) or "1"
    return f"avg(CASE WHEN n < {k} THEN (c > 0)::INT::DOUBLE ELSE 1 - {factors} END)"


def _pass_hat(k: int) -> str:
    factors = " * ".join(f"((c - {i}) / (n - {i})::DOUBLE)" for i in range(k)) or "1"
    return f"avg(CASE WHEN n < {k} THEN (c = n)::INT::DOUBLE ELSE greatest({factors}, 0) END)"


_QUART = """q AS (SELECT model, quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi, quantile_cont(score, 0.1) AS v, quantile_cont(score, 0.9) AS u FROM ep GROUP BY model)"""
_COUNTS = "k AS (SELECT model, task, count(*) AS n, sum(success::INT) AS c FROM ep GROUP BY model, task)"


@on_episodes(
    "summarize_by_model",
    f"""{_QUART}, {_COUNTS},
p AS (SELECT model, {", ".join(f"round({f(x)}, 6) AS {n}_{x}" for x in (1, 4, 8) for n, f in (("pass_at", _pass_at), ("pass_hat", _pass_hat)))} FROM k GROUP BY model),
s AS (SELECT model, count(*)::BIGINT AS n_episodes, round(avg(score), 6) AS mean, round(avg(score) FILTER (score BETWEEN lo AND hi), 6) AS iqm, round(median(score), 6) AS median,
  round(stddev_samp(score), 6) AS std, round(any_value(v), 6) AS var_a, round(avg(score) FILTER (score <= v), 6) AS cvar_a, round(avg(success::INT), 6) AS success_rate
  FROM ep JOIN q USING (model) GROUP BY model)
SELECT * FROM s JOIN p USING (model)""",
)
def summarize_by_model(ep):
    return metrics.summarize(ep, ["model"])


on_episodes("iqm_by_difficulty", "SELECT s_difficulty, round(avg(score) FILTER (score BETWEEN lo AND hi), 6) AS iqm FROM ep JOIN (SELECT s_difficulty, quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi FROM ep GROUP BY s_difficulty) USING (s_difficulty) GROUP BY s_difficulty")(lambda ep: metrics.iqm(ep, ["s_difficulty"]))
on_episodes("value_at_risk", "SELECT model, round(quantile_cont(score, 0.1), 6) AS var FROM ep GROUP BY model")(lambda ep: metrics.value_at_risk(ep, ["model"]))
on_episodes("cvar_by_difficulty", "SELECT s_difficulty, round(avg(score) FILTER (score <= v), 6) AS cvar FROM ep JOIN (SELECT s_difficulty, quantile_cont(score, 0.1) AS v FROM ep GROUP BY s_difficulty) USING (s_difficulty) GROUP BY s_difficulty")(lambda ep: metrics.cvar(ep, ["s_difficulty"]))
on_episodes("cvar_upper", f"{_QUART} SELECT model, round(avg(score) FILTER (score >= u), 6) AS cvar FROM ep JOIN q USING (model) GROUP BY model")(lambda ep: metrics.cvar(ep, ["model"], tail="upper"))
on_episodes("task_counts", "SELECT model, task, count(*)::BIGINT AS n, sum(success::INT)::BIGINT AS c FROM ep GROUP BY model, task")(lambda ep: metrics.task_counts(ep, ["model"]))
_KS = (1, 2, 3, 4, 8)
_CURVE = " UNION ALL ".join(f"SELECT model, {k} AS k, {_pass_at(k)} AS pass_at_k, {_pass_hat(k)} AS pass_hat_k FROM k GROUP BY model" for k in _KS)
on_episodes("pass_at_k_curve", f"{_COUNTS} SELECT model, k::INT AS k, round(pass_at_k, 6) AS pass_at_k, round(pass_hat_k, 6) AS pass_hat_k FROM ({_CURVE})")(lambda ep: metrics.pass_curve(ep, _KS, ["model"]))
on_episodes("reliability_decay", f"{_COUNTS}, curve AS ({_CURVE}) SELECT model, round(regr_slope(pass_hat_k, k), 6) AS slope, round(min_by(pass_hat_k, k) - max_by(pass_hat_k, k), 6) AS total_drop FROM curve GROUP BY model")(lambda ep: metrics.reliability_decay(ep, _KS, ["model"]))
on_episodes("variance_amplification", "SELECT model, round(var_samp(score) FILTER (length > 25) / var_samp(score) FILTER (length <= 25), 6) AS vaf FROM ep GROUP BY model")(lambda ep: metrics.variance_amplification(ep, F.col("length") <= 25, F.col("length") > 25, ["model"]))
on_episodes("optimality_gap", "SELECT model, round(1.0 - avg(score), 6) AS optimality_gap FROM ep GROUP BY model")(lambda ep: metrics.optimality_gap(ep, ["model"]))
_TAUS = [0.0, 0.25, 0.5, 0.75, 1.0]
on_episodes("performance_profile", f"SELECT model, tau, round(avg((score >= tau)::INT), 6) AS fraction FROM ep, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _TAUS)}]) AS tau) GROUP BY model, tau")(lambda ep: metrics.performance_profile(ep, _TAUS, ["model"]))
on_episodes("ecdf", "SELECT DISTINCT model, score, round(cume_dist() OVER (PARTITION BY model ORDER BY score), 6) AS cdf FROM ep")(lambda ep: metrics.ecdf(ep, ["model"]))
on_episodes(
    "failure_distribution",
    "SELECT s_difficulty, failure_mode, n, round(n / sum(n) OVER (PARTITION BY s_difficulty), 6) AS share_of_failures FROM (SELECT s_difficulty, coalesce(failure_mode, 'unlabeled') AS failure_mode, count(*)::BIGINT AS n FROM ep WHERE NOT success GROUP BY 1, 2)",
)(lambda ep: failure.failure_distribution(ep, ["s_difficulty"]))
_CRIT = "crit AS (SELECT s_difficulty, unnest([{'criterion': 'score_ok', 'passed': score >= 0.5}, {'criterion': 'short', 'passed': length <= 20}, {'criterion': 'success', 'passed': success}], recursive := true) FROM ep)"


def _criteria(ep):
    return ep.withColumn("criteria", F.create_map(F.lit("score_ok"), F.col("score") >= 0.5, F.lit("short"), F.col("length") <= 20, F.lit("success"), F.col("success")))


on_episodes("criterion_failure_rates", f"{_CRIT} SELECT s_difficulty, criterion, count(*)::BIGINT AS n_episodes, sum((NOT passed)::INT)::BIGINT AS n_failed, round(avg((NOT passed)::INT), 6) AS failure_rate FROM crit GROUP BY 1, 2")(
    lambda ep: failure.criterion_failure_rates(_criteria(ep), ["s_difficulty"])
)
on_episodes("top_failing_criteria", f"{_CRIT} SELECT criterion, count(*)::BIGINT AS n_episodes, sum((NOT passed)::INT)::BIGINT AS n_failed, round(avg((NOT passed)::INT), 6) AS failure_rate FROM crit GROUP BY 1 ORDER BY failure_rate DESC, criterion LIMIT 2")(
    lambda ep: failure.top_failing_criteria(_criteria(ep), 2)
)
_RUNS = "runs AS (SELECT model, run_id, avg(score) AS stat FROM ep GROUP BY model, run_id)"
on_episodes(
    "meta_distribution",
    f"{_RUNS} SELECT model, count(*)::BIGINT AS n_repeats, round(avg(stat), 6) AS mean, round(coalesce(stddev_samp(stat), 0), 6) AS std, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi, round(max(stat) - min(stat), 6) AS spread FROM runs GROUP BY model",
)(lambda ep: metrics.meta_distribution(ep, F.avg("score"), by=["model"]))
on_episodes(
    "is_gap_real",
    f"{_RUNS}, o AS (SELECT model, stat, row_number() OVER (PARTITION BY model ORDER BY run_id) AS i FROM runs WHERE model IN ('AF', 'RF')), p AS (SELECT i, max(stat) FILTER (model = 'AF') AS a, max(stat) FILTER (model = 'RF') AS b FROM o GROUP BY i) "
    "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::BIGINT AS n_pairs, round(avg((a > b)::INT) FILTER (a IS NOT NULL AND b IS NOT NULL), 6) AS p_a_better, min(a) <= max(b) AND min(b) <= max(a) AS ranges_overlap FROM p",
)(lambda ep: metrics.gap_is_real(ep, A(), B(), F.avg("score")))

_PROFILE = """g AS (SELECT model, task, max(score) AS q_star, avg(score) AS q_bar, list(score ORDER BY ord) AS scores FROM ep GROUP BY model, task),
prof AS (SELECT *, q_star - q_bar AS gap, CASE WHEN q_star = 0 THEN 'stuck' WHEN q_star - q_bar < 1e-9 THEN 'solid' ELSE 'recoverable' END AS kind FROM g),
profile AS (SELECT *, CASE kind WHEN 'stuck' THEN 0.0::DOUBLE WHEN 'solid' THEN 1.0::DOUBLE ELSE q_bar / q_star END AS consistency FROM prof)"""
_BINS = " + ".join(f"coalesce(-(n{i} / n) * ln(nullif(n{i}, 0) / n), 0)" for i in range(5))
_ENTROPY = f"""bins AS (SELECT model, task, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER (score >= lo + {i} * ((hi - lo) / 5) AND {'score <= hi' if i == 4 else f'score < lo + {i + 1} * ((hi - lo) / 5)'}) AS n{i}" for i in range(5))}, any_value(lo) AS lo, any_value(hi) AS hi
FROM ep JOIN (SELECT model, task, min(score) AS lo, max(score) AS hi FROM ep GROUP BY model, task) USING (model, task) GROUP BY model, task),
ent AS (SELECT model, task, CASE WHEN n < 2 OR lo = hi THEN 0.0 ELSE {_BINS} END AS outcome_entropy FROM bins)"""
on_episodes(
    "task_taxonomy",
    f"{_PROFILE} SELECT model, task, kind, round(q_star, 9) AS q_star, round(q_bar, 9) AS q_bar, round(gap, 9) AS gap, round(consistency, 9) AS consistency, len(list_filter(scores, lambda s: s >= 0.9 * q_star AND q_star > 0))::INT AS n_reinforce, len(list_filter(scores, lambda s: s < 0.9 * q_star AND q_star > 0))::INT AS n_contrast FROM profile", places=9)(lambda ep: taxonomy.task_profiles(ep).select("model", "task", "kind", "q_star", "q_bar", "gap", "consistency", "n_reinforce", "n_contrast"))
on_episodes("outcome_entropy", f"{_ENTROPY} SELECT model, task, round(outcome_entropy, 6) AS outcome_entropy FROM ent")(lambda ep: taxonomy.task_profiles(ep).select("model", "task", "outcome_entropy"))
_TAIL = """SELECT model, count(*)::BIGINT AS n_tasks, sum(len(scores))::BIGINT AS n_episodes, count(*) FILTER (kind = 'solid')::BIGINT AS n_solid, count(*) FILTER (kind = 'recoverable')::BIGINT AS n_recoverable, count(*) FILTER (kind = 'stuck')::BIGINT AS n_stuck,
round(sum(gap), 6) AS total_gap, round(sum(q_star), 6) AS sum_q_star, round(sum(q_bar), 6) AS sum_q_bar, round(count(*) FILTER (kind = 'recoverable') / count(*), 6) AS pct_recoverable, round(sum(q_bar) / sum(q_star), 6) AS consistency_index FROM profile GROUP BY model"""
on_episodes(
    "reinforce_indices",
    f"{_PROFILE}, x AS (SELECT model, task, q_star, unnest(scores) AS s, unnest(range(0, len(scores))) AS i FROM profile) SELECT model, task, i::BIGINT AS attempt, round(q_star - s, 6) AS residual, CASE WHEN q_star > 0 THEN s >= 0.9 * q_star END AS reinforce FROM x",
)(lambda ep: taxonomy.attempts(ep).select("model", "task", "attempt", "residual", "reinforce"))
on_episodes("compare_agents", f"{_PROFILE}, tail AS ({_TAIL}) SELECT model, n_tasks, n_recoverable, round(pct_recoverable, 3) AS pct_recoverable, round(total_gap, 4) AS total_gap, round(sum_q_star, 4) AS sum_q_star, round(sum_q_bar, 4) AS sum_q_bar, round(consistency_index, 4) AS consistency_index FROM tail")(
    lambda ep: taxonomy.compare_agents(taxonomy.task_profiles(ep))
)
on_episodes("right_tail_report", f"{_PROFILE} {_TAIL}")(lambda ep: taxonomy.right_tail(taxonomy.task_profiles(ep)))
on_episodes("recoverable_priority", f"{_PROFILE} SELECT model, task, round(gap, 6) AS gap, round(gap * (1 - consistency), 6) AS priority FROM profile WHERE kind = 'recoverable' ORDER BY gap DESC, task, model LIMIT 25")(
    lambda ep: taxonomy.task_profiles(ep).where("kind = 'recoverable'").select("model", "task", "gap", "priority").orderBy(F.desc("gap"), "task", "model").limit(25)
)
on_episodes("priority_eig", f"{_PROFILE}, {_ENTROPY} SELECT model, task, round(outcome_entropy * (1 - consistency), 6) AS priority_eig FROM profile JOIN ent USING (model, task) WHERE kind = 'recoverable'")(lambda ep: taxonomy.task_profiles(ep).where("kind = 'recoverable'").select("model", "task", "priority_eig"))
on_episodes("score_matrix", "SELECT run_id, round(avg(score) FILTER (s_difficulty = 'easy'), 6) AS easy, round(avg(score) FILTER (s_difficulty = 'hard'), 6) AS hard, round(avg(score) FILTER (s_difficulty = 'medium'), 6) AS medium FROM ep GROUP BY run_id")(
    lambda ep: ep.groupBy("run_id").pivot("s_difficulty", ["easy", "hard", "medium"]).agg(F.avg("score"))
)
on_episodes("response_matrix", "SELECT model, task, (avg(success::INT) >= 0.5)::INT AS x FROM ep GROUP BY model, task")(lambda ep: inference.responses(ep))
on_episodes("reduce_scores", f"v AS (SELECT quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi, quantile_cont(score, 0.1) AS v FROM ep) SELECT count(*)::BIGINT AS n, round(avg(score), 6) AS mean, round(avg(score) FILTER (score BETWEEN lo AND hi), 6) AS iqm, round(stddev_samp(score), 6) AS std, round(any_value(v), 6) AS var_a, round(avg(score) FILTER (score <= v), 6) AS cvar_a, round(min(score), 6) AS min, round(avg((score = 0)::INT), 6) AS frac_zero, 0::BIGINT AS n_missing FROM ep, v")(
    lambda ep: metrics.reduce_scores(ep)
)
on_episodes("grouping_sets", "SELECT s_difficulty, run_id, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, round(avg(success::INT), 6) AS success_rate FROM ep GROUP BY GROUPING SETS ((), (s_difficulty), (run_id))")(lambda ep: metrics.grouping_summary(ep, ["s_difficulty", "run_id"]))
_RANKED = f"""{_QUART}, {_COUNTS}, p AS (SELECT model, {_pass_hat(3)} AS ph FROM k GROUP BY model), s AS (SELECT model, avg(score) AS mean, avg(score) FILTER (score BETWEEN lo AND hi) AS iqm, avg(score) FILTER (score <= v) AS cvar FROM ep JOIN q USING (model) GROUP BY model)"""
on_episodes("agent_reliability_rank", f"{_RANKED} SELECT model, round(mean, 6) AS mean, round(2 * cvar + ph + iqm, 6) AS reliability, rank() OVER (ORDER BY round(2 * cvar + ph + iqm, 9) DESC)::INT AS reliability_rank, rank() OVER (ORDER BY round(mean, 9) DESC)::INT AS mean_rank FROM s JOIN p USING (model)")(
    lambda ep: agent_ranks(ep)
)


def agent_ranks(ep: DataFrame) -> DataFrame:
    """Rank by 2 CVaR + pass^3 + IQM beside the rank by mean: an inversion is where they disagree."""
    from pyspark.sql import Window

    s = metrics.summarize(ep, ["model"], ks=(3,)).withColumn("reliability", 2 * F.col("cvar_a") + F.col("pass_hat_3") + F.col("iqm"))
    rank = lambda c: F.rank().over(Window.orderBy(F.round(c, 9).desc()))
    return s.select("model", "mean", "reliability", rank("reliability").alias("reliability_rank"), rank("mean").alias("mean_rank"))


# ------------------------------------------------------------- windows W1-W11
on_episodes(
    "grpo_advantages_summary",
    "a AS (SELECT model, task, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8) AS advantage FROM ep WINDOW w AS (PARTITION BY model, task)) SELECT model, round(sum(advantage * advantage), 3) AS ss, round(min(advantage), 4) AS lowest, round(max(advantage), 4) AS highest, count(*) FILTER (advantage > 1e-6)::BIGINT AS n_positive FROM a GROUP BY model",
)(lambda ep: windows.grpo_advantages(ep, ["model", "task"]).groupBy("model").agg(F.round(F.sum(F.col("advantage") * F.col("advantage")), 3).alias("ss"), F.round(F.min("advantage"), 4).alias("lowest"), F.round(F.max("advantage"), 4).alias("highest"), F.sum((F.col("advantage") > 1e-6).cast("bigint")).alias("n_positive")))
_RADIUS = f"sqrt(ln(2.0 / ({(1 - 0.95) * 6 / math.pi**2!r} / (t * t))) / (2.0 * t))"
on_episodes(
    "confidence_sequence",
    f"r AS (SELECT model, task, ord, row_number() OVER w AS t, avg(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ep WINDOW w AS (PARTITION BY model, task ORDER BY ord)) "
    f"SELECT model, task, ord, t::INT AS t, round(m, 9) AS running_mean, round(greatest(0, least(1, m - {_RADIUS})), 9) AS running_lo, round(greatest(0, least(1, m + {_RADIUS})), 9) AS running_hi FROM r", places=9)(lambda ep: windows.confidence_sequence(ep, ["ord"], ["model", "task"]).select("model", "task", "ord", "t", "running_mean", "running_lo", "running_hi"))
_P = "p AS (SELECT model, task, round(avg(score) / 20 + count(*) * 0.0001, 8) AS p FROM ep GROUP BY model, task), o AS (SELECT model, task, p, row_number() OVER (PARTITION BY model ORDER BY p, task) AS i, count(*) OVER (PARTITION BY model) AS n FROM p)"


def _pvalues(ep):
    return ep.groupBy("model", "task").agg(F.round(F.avg("score") / 20 + F.count(F.lit(1)) * 0.0001, 8).alias("p"))


on_episodes("adjust_pvalues_bh", f"{_P} SELECT model, task, round(p, 6) AS p, round(least(1.0, min(n / i * p) OVER (PARTITION BY model ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM o")(lambda ep: windows.adjust_pvalues(_pvalues(ep), by=["model"]))
on_episodes("adjust_pvalues_holm", f"{_P} SELECT model, task, round(p, 6) AS p, round(least(1.0, max((n - i + 1) * p) OVER (PARTITION BY model ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted FROM o")(
    lambda ep: windows.adjust_pvalues(_pvalues(ep), method="holm", by=["model"])
)
on_episodes("average_ranks", "SELECT model, score, round(avg(r), 6) AS avg_rank FROM (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) AS r FROM ep) GROUP BY model, score")(lambda ep: windows.average_ranks(ep, "score", ["model"]).select("model", "score", "avg_rank").distinct())
on_episodes(
    "kappa_changes",
    "c AS (SELECT model, substr(run_id, 5)::INT AS cycle, avg(score) AS kappa FROM ep GROUP BY 1, 2), d AS (SELECT *, kappa - lag(kappa) OVER (PARTITION BY model ORDER BY cycle) AS delta FROM c) SELECT model, cycle, round(kappa, 6) AS kappa, round(delta, 6) AS delta, coalesce(abs(delta) < 0.01, false) AS plateaued FROM d",
)(lambda ep: windows.kappa_changes(ep.groupBy("model", F.substring("run_id", 5, 9).cast("int").alias("cycle")).agg(F.avg("score").alias("kappa")), ["model"]))
on_episodes("episode_numbering", "SELECT model, task, max(episode)::INT AS last_episode, count(DISTINCT episode)::BIGINT AS n FROM (SELECT run_id, model, task, row_number() OVER (PARTITION BY run_id, model, task ORDER BY ord) - 1 AS episode FROM ep) GROUP BY model, task")(
    lambda ep: _numbered(ep).groupBy("model", "task").agg(F.max("episode").alias("last_episode"), F.countDistinct("episode").alias("n"))
)


def _numbered(ep):
    from episodeframe.frame import Episodes

    return Episodes(ep).numbered().df


# ---------------------------------------------------------- filters F1-F10
def _frame(f):
    from episodeframe.frame import Episodes

    return lambda ep: f(Episodes(ep)).df


on_episodes("slice_equal", "SELECT model, count(*)::BIGINT AS n FROM ep WHERE s_difficulty = 'hard' AND run_id = 'run_1996' GROUP BY model")(lambda ep: _frame(lambda e: e.slice(difficulty="hard", run_id="run_1996"))(ep).groupBy("model").agg(F.count(F.lit(1)).alias("n")))
on_episodes("query_range", "SELECT run_id, model, task, episode, score FROM ep WHERE score BETWEEN 0.25 AND 0.75 AND model IN ('AF', 'RF') AND s_difficulty IN ('easy', 'hard') AND NOT success")(
    lambda ep: _frame(lambda e: e.query(score_min=0.25, score_max=0.75, success=False, models=["AF", "RF"], difficulty=["easy", "hard"]))(ep).select("run_id", "model", "task", "episode", "score")
)
on_episodes("filter_predicate", "SELECT count(*)::BIGINT AS n, sum(length)::BIGINT AS total FROM ep WHERE length % 7 = 3 AND score > 0.4")(lambda ep: _frame(lambda e: e.filter((F.col("length") % 7 == 3) & (F.col("score") > 0.4)))(ep).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")))
on_episodes("completed_only", "SELECT count(*)::BIGINT AS n FROM ep WHERE failure_mode IS DISTINCT FROM 'missing_reward'")(lambda ep: _frame(lambda e: e.completed())(ep).agg(F.count(F.lit(1)).alias("n")))
on_episodes("score_projection", "SELECT score, count(*)::BIGINT AS n FROM ep GROUP BY score")(lambda ep: _frame(lambda e: e)(ep).select("score").groupBy("score").agg(F.count(F.lit(1)).alias("n")))
on_episodes("outcome_classes", "SELECT CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS outcome, count(*)::BIGINT AS n FROM ep GROUP BY 1")(lambda ep: ep.groupBy(F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.25, "medium").otherwise("low").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))

# -------------------------------------------------------- comparison C1-C20
_CDF = """c AS (SELECT s_difficulty AS d, score, count(*) FILTER (model = 'AF') AS na, count(*) FILTER (model = 'RF') AS nb FROM ep WHERE model IN ('AF', 'RF') GROUP BY 1, 2),
f AS (SELECT d, score, na, nb, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY d) AS ta, sum(nb) OVER (PARTITION BY d) AS tb, lead(score) OVER (PARTITION BY d ORDER BY score) AS nx FROM c WINDOW w AS (PARTITION BY d ORDER BY score))"""
on_episodes(
    "distances",
    f"{_CDF} SELECT d AS s_difficulty, any_value(ta)::BIGINT AS n_a, any_value(tb)::BIGINT AS n_b, round(sum(abs(ca / ta - cb / tb) * (nx - score)), 6) AS wasserstein, round(max(abs(ca / ta - cb / tb)), 6) AS ks_d, round(sum(na * (cb - nb + nb / 2)) / any_value(ta * tb), 6) AS prob_improvement, round(sum(na * (cb - nb + nb / 2)), 6) AS mwu_u FROM f GROUP BY d",
)(lambda ep: compare.distances(ep, A(), B(), ["s_difficulty"]).drop("tie_term"))
on_episodes("effect_size", "SELECT s_difficulty, round((avg(score) FILTER (model = 'AF') - avg(score) FILTER (model = 'RF')) / sqrt((var_samp(score) FILTER (model = 'AF') + var_samp(score) FILTER (model = 'RF')) / 2), 6) AS effect_size FROM ep GROUP BY s_difficulty")(
    lambda ep: compare.effect_size(ep, A(), B(), ["s_difficulty"])
)
on_episodes(
    "stochastic_dominance",
    """e AS (SELECT s_difficulty AS d, min(score) AS lo, max(score) AS hi FROM ep WHERE model IN ('AF', 'RF') GROUP BY 1),
x AS (SELECT d, i, (hi - lo) / 199 AS dx, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS x FROM e, (SELECT unnest(range(0, 200)) AS i)),
s AS (SELECT s_difficulty AS d, score, count(*) FILTER (model = 'AF') AS na, count(*) FILTER (model = 'RF') AS nb FROM ep WHERE model IN ('AF', 'RF') GROUP BY 1, 2),
t AS (SELECT x.d, i, any_value(dx) AS dx, coalesce(sum(na) FILTER (score <= x), 0) / sum(na) AS fa, coalesce(sum(nb) FILTER (score <= x), 0) / sum(nb) AS fb FROM x JOIN s ON x.d = s.d GROUP BY x.d, i),
a AS (SELECT d, fa, fb, sum(fa) OVER w * dx AS ia, sum(fb) OVER w * dx AS ib FROM t WINDOW w AS (PARTITION BY d ORDER BY i))
SELECT d AS s_difficulty, bool_and(fa <= fb + 1e-9) AS fsd_a_over_b, bool_and(fb <= fa + 1e-9) AS fsd_b_over_a, bool_and(ia <= ib + 1e-9) AS ssd_a_over_b, bool_and(ib <= ia + 1e-9) AS ssd_b_over_a FROM a GROUP BY d""",
)(lambda ep: compare.dominance(ep, A(), B(), ["s_difficulty"]))
on_episodes(
    "length_bias",
    "r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY model ORDER BY length) + (count(*) OVER (PARTITION BY model, length) - 1) / 2 AS rl FROM ep) SELECT model, count(*)::BIGINT AS n, round(corr(rs, rl), 6) AS rho FROM r GROUP BY model",
)(lambda ep: compare.length_bias(ep, ["model"]))
_Z = special.normal_ppf(0.975)
on_episodes("analytical_ci", f"SELECT model, round(avg(score), 6) AS point, round(avg(score) - {_Z} * stddev_samp(score) / sqrt(count(*)), 6) AS lo, round(avg(score) + {_Z} * stddev_samp(score) / sqrt(count(*)), 6) AS hi, round(2 * {_Z} * stddev_samp(score) / sqrt(count(*)), 6) AS width FROM ep GROUP BY model")(
    lambda ep: compare.analytical_ci(ep, ["model"])
)
on_episodes(
    "wilson_ci",
    f"w AS (SELECT model, sum(success::INT) AS k, count(*) AS n, k / n AS p, (p + {_Z}*{_Z} / (2 * n)) / (1 + {_Z}*{_Z} / n) AS c, {_Z} * sqrt((p * (1 - p) + {_Z}*{_Z} / (4 * n)) / n) / (1 + {_Z}*{_Z} / n) AS m FROM ep GROUP BY model) SELECT model, k::BIGINT AS k, n::BIGINT AS n, round(p, 6) AS point, round(greatest(0, c - m), 6) AS lo, round(least(1, c + m), 6) AS hi FROM w",
)(lambda ep: compare.wilson_ci(ep, ["model"]))
on_episodes("clopper_pearson_ci")(lambda ep: compare.clopper_pearson_ci(ep, ["model", "s_difficulty"]))
_PAIRS = "m AS (SELECT task, model, avg(score) AS s FROM ep GROUP BY task, model), pr AS (SELECT a.model AS a, b.model AS b, CASE WHEN round(a.s, 9) > round(b.s, 9) THEN 1.0 WHEN round(a.s, 9) < round(b.s, 9) THEN 0.0 ELSE 0.5 END AS s FROM m a JOIN m b ON a.task = b.task AND a.model < b.model)"


def model_pairs(ep: DataFrame) -> DataFrame:
    """Results of models (few) on the same task."""
    m = ep.groupBy("task", "model").agg(F.round(F.avg("score"), 9).alias("s"))
    a, b = m.select("task", F.col("model").alias("a"), F.col("s").alias("_x")), m.select("task", F.col("model").alias("b"), F.col("s").alias("_y"))
    return a.join(b, "task").where("a < b").select("a", "b", F.when(F.col("_x") > F.col("_y"), 1.0).when(F.col("_x") < F.col("_y"), 0.0).otherwise(0.5).alias("s"))


on_episodes("win_matrix", f"{_PAIRS} SELECT i, j, round(sum(w), 6) AS wins FROM (SELECT a AS i, b AS j, s::DOUBLE AS w FROM pr UNION ALL SELECT b, a, 1 - s FROM pr) GROUP BY i, j")(lambda ep: compare.win_counts(model_pairs(ep)))


@on_episodes("bradley_terry")
def bradley_terry(ep):
    r = inference.bradley_terry(compare.win_counts(model_pairs(ep)))
    return ep.sparkSession.createDataFrame([(n, float(s), float(p)) for n, s, p in zip(r["items"], r["strengths"], r["probs"], strict=True)], "model string, strength double, prob double")


on_episodes("bootstrap_ci")(lambda ep: inference.bootstrap_ci(ep, "mean", ["model"], reps=5000))
on_episodes("bootstrap_vs_repeat")(lambda ep: inference.bootstrap_vs_repeat(ep, strata=["model"], reps=1000))


@on_episodes("fit_2pl")
def fit_2pl(ep):
    cells = ep.withColumn("agent", F.concat("model", "run_id"))
    _, items = inference.fit_2pl(inference.responses(cells, "agent"), "agent", max_iter=50)
    return ep.sparkSession.createDataFrame(items)


_ITEMS = "items AS (SELECT task, 0.5 + avg(score) AS a, 1 - 2 * avg(success::INT) AS b FROM ep GROUP BY task)"


def _items(ep):
    return ep.groupBy("task").agg((0.5 + F.avg("score")).alias("a"), (1 - 2 * F.avg(F.col("success").cast("int"))).alias("b"))


_INFO = "a * a * (1 / (1 + exp(-a * (t - b)))) * (1 - 1 / (1 + exp(-a * (t - b))))"
on_episodes("item_information", f"{_ITEMS} SELECT t AS theta, round(sum({_INFO}), 6) AS information FROM items, (SELECT unnest([-1.0::DOUBLE, 0.0, 1.0]) AS t) GROUP BY t")(lambda ep: inference.total_information(_items(ep), [-1.0, 0.0, 1.0]))
on_episodes("select_items", f"{_ITEMS} SELECT task, round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, round(sum({_INFO}), 6) AS information FROM items, (SELECT unnest([-1.0::DOUBLE, 0.0, 1.0]) AS t) GROUP BY task ORDER BY sum({_INFO}) DESC, task LIMIT 10")(
    lambda ep: inference.select_items(_items(ep), 10, [-1.0, 0.0, 1.0])
)
_PPI = "select cast(l.quality as double) as gold, case when n_chars % 7 < 4 then 1.0 else 0.0 end + case when l.quality = 1 then cast(0.25 as double) else 0 end as judge from {documents} d left join {labels} l on d.doc_id = l.doc_id"


def _ppi(spark, sf_dir):
    return rounded(inference.ppi_mean(sql(spark, sf_dir, _PPI)))


register(
    "ppi_mean",
    f"""WITH d AS ({_plain(_PPI)}),
m AS (SELECT count(gold) AS n, count(*) FILTER (gold IS NULL) AS big, avg(gold) AS mg, avg(judge) FILTER (gold IS NOT NULL) AS mj, avg(judge) FILTER (gold IS NULL) AS mu, var_samp(gold) AS vg, var_samp(judge) FILTER (gold IS NOT NULL) AS vj, var_samp(judge) FILTER (gold IS NULL) AS vu, covar_samp(gold, judge) FILTER (gold IS NOT NULL) AS cv FROM d),
l AS (SELECT *, greatest(0, least(1, cv / (vj + n / big * vu))) AS lam FROM m),
e AS (SELECT n, big, lam, mg + lam * (mu - mj) AS point, sqrt((vg + lam * lam * vj - 2 * lam * cv) / n + lam * lam * vu / big) AS se FROM l)
SELECT n::BIGINT AS n, big::BIGINT AS big_n, round(lam, 6) AS lam, round(point, 6) AS point, round(se, 6) AS se, round(point - {_Z} * se, 6) AS lo, round(point + {_Z} * se, 6) AS hi FROM e""",
    ep=False,
)(_ppi)

# ------------------------------------------------------------- pool A24-A31
_POOL = f"pool AS ({POOL_SQL})"
_SPREAD = "count(*)::BIGINT AS n_records, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, arg_max(agent_name, (score, -ord)) AS best_agent, arg_min(agent_name, (score, ord)) AS worst_agent, round(max(score) - min(score), 6) AS disagreement"


def on_pool(name: str, oracle: str | None = None):
    def add(f):
        register(name, f"{_POOL} {oracle}".replace(") ,", "),") if oracle else None)(lambda spark, sf_dir: rounded(f(pool_records(spark, sf_dir))))
        return f

    return add


on_pool("pool_by_task", f"SELECT task, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, {_SPREAD} FROM pool GROUP BY task")(pool.aggregate_by_task)
on_pool("agent_variances", "SELECT agent_name, round(coalesce(var_samp(score), 1.0), 6) AS variance FROM pool GROUP BY agent_name")(pool.agent_variances)
on_pool(
    "pool_by_task_ivw",
    f", v AS (SELECT agent_name, 1 / greatest(coalesce(var_samp(score), 1.0), 1e-6) AS w FROM pool GROUP BY agent_name) SELECT task, round(sum(w * score) / sum(w), 6) AS mean_score, round(sqrt(1 / sum(w)), 6) AS std_score, {_SPREAD} FROM pool JOIN v USING (agent_name) GROUP BY task",
)(pool.aggregate_by_task_ivw)
on_pool("pool_by_task_robust")(pool.aggregate_by_task_robust)
on_pool("weighted_median", ", s AS (SELECT agent_name, task, score, sum(1 + ord % 3) AS w FROM pool GROUP BY 1, 2, 3), c AS (SELECT task, score, sum(w) AS w FROM s GROUP BY 1, 2), r AS (SELECT task, score, sum(w) OVER (PARTITION BY task ORDER BY score) AS c, sum(w) OVER (PARTITION BY task) AS t FROM c) SELECT task, round(min(score), 6) AS weighted_median FROM r WHERE c >= t / 2 GROUP BY task")(
    lambda p: pool.weighted_median(p.withColumn("w", 1 + F.col("ord") % 3), "score", "w", ["task"])
)
on_pool(
    "cross_agent_pairs",
    ", g AS (SELECT task, count(*) AS n, arg_max({'agent_name': agent_name, 'score': score}, (score, -ord)) AS p, arg_min({'agent_name': agent_name, 'score': score}, (score, ord)) AS m FROM pool GROUP BY task) "
    "SELECT task, p.agent_name AS positive_agent, m.agent_name AS negative_agent, round(p.score, 6) AS positive_score, round(m.score, 6) AS negative_score, round(p.score - m.score, 6) AS gap, CASE WHEN least(p.score, 0.5) > least(m.score, 0.5) THEN 'ck0,ck1' ELSE 'ck0' END AS checkpoints FROM g WHERE n >= 2 AND p.score - m.score >= 0.1",
)(lambda p: pool.cross_agent_pairs(p).select("task", "positive_agent", "negative_agent", "positive_score", "negative_score", "gap", F.array_join("disagreement_checkpoints", ",").alias("checkpoints")))
on_pool("pool_agents", "SELECT agent_name, count(DISTINCT task)::BIGINT AS n_tasks, count(*)::BIGINT AS n_records FROM pool GROUP BY agent_name")(lambda p: p.groupBy("agent_name").agg(F.countDistinct("task").alias("n_tasks"), F.count(F.lit(1)).alias("n_records")))


# ------------------------------------------------------ trajectories T1-T16
_TOOLS = {n: ", ".join(f"'{x}'" for x in v) for n, v in (("w", trajectory.WRITES), ("e", trajectory.EXECS), ("r", trajectory.READS))}
_PREFIX = f"""p AS (SELECT trial_id, event_id, tool, row_number() OVER w AS k FROM calls WINDOW w AS (PARTITION BY trial_id ORDER BY ts, event_id)),
f AS (SELECT trial_id, event_id, k, count(*) FILTER (tool IN ({_TOOLS['r']})) OVER v AS n_reads, count(*) FILTER (tool IN ({_TOOLS['w']})) OVER v AS n_writes, count(*) FILTER (tool IN ({_TOOLS['e']})) OVER v AS n_exec, count(*) FILTER (tool = 'search_tool') OVER v AS n_search,
 coalesce(min(k - 1) FILTER (tool IN ({_TOOLS['w']})) OVER v, k) AS fw, coalesce(min(k - 1) FILTER (tool IN ({_TOOLS['e']})) OVER v, k) AS fe, coalesce(min(k - 1) FILTER (tool IN ({_TOOLS['r']})) OVER v, k) AS fr,
 len(list_distinct(list(tool) OVER v)) AS kinds FROM p WINDOW v AS (PARTITION BY trial_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_FEATURES = "n_reads::BIGINT AS n_reads, n_writes::BIGINT AS n_writes, n_exec::BIGINT AS n_exec, n_search::BIGINT AS n_search, fw::INT AS first_write_pos, fe::INT AS first_exec_pos, round(n_search / k, 6) AS search_ratio, round(kinds / k, 6) AS tool_diversity, (fw < k AND fr < k AND fw < fr) AS write_before_read"
register("prefix_features", f"{CALLS}, {_PREFIX} SELECT trial_id, event_id, k::INT AS prefix_len, {_FEATURES} FROM f", ep=False)(
    lambda spark, sf_dir: rounded(trajectory.prefix_features(calls(spark, sf_dir), "trial_id", ["ts", "event_id"]).select("trial_id", "event_id", "prefix_len", "n_reads", "n_writes", "n_exec", "n_search", "first_write_pos", "first_exec_pos", "search_ratio", "tool_diversity", "write_before_read"))
)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a trial: its tools in order, and a score made of its user."""
    c = calls(spark, sf_dir)
    out = c.groupBy("trial_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool"))).alias("_c"))
    return out.select("trial_id", "user_id", F.transform("_c", lambda x: x["tool"]).alias("tool_sequence"), ((F.col("user_id") % 11) / 10.0).alias("score"), F.concat(F.lit("tasks/task-"), (F.col("user_id") % 17).cast("string")).alias("task_path"))


_SEQ = f"{CALLS}, s AS (SELECT trial_id, user_id, list(tool ORDER BY ts, event_id) AS seq, user_id % 11 / 10.0::DOUBLE AS score, concat('tasks/task-', (user_id % 17)::VARCHAR) AS task_path FROM calls GROUP BY 1, 2)"
register(
    "trajectory_features",
    f"{_SEQ}, {_PREFIX} SELECT f.trial_id, k::INT AS prefix_len, {_FEATURES.replace('::BIGINT', '::INT')} FROM f JOIN (SELECT trial_id, max(k) AS k FROM f GROUP BY trial_id) USING (trial_id, k)",
    ep=False,
)(lambda spark, sf_dir: rounded(trajectory.features(sequences(spark, sf_dir)).select("trial_id", "prefix_len", "n_reads", "n_writes", "n_exec", "n_search", "first_write_pos", "first_exec_pos", "search_ratio", "tool_diversity", "write_before_read")))


@register("outcome_predictions")
def outcome_predictions(spark, sf_dir):
    rows = trajectory.features(sequences(spark, sf_dir))
    return rounded(trajectory.check(rows, trajectory.fit_predictor(rows)).select("trial_id", "p_high", "prediction", "confidence", "warning"))


@register("phase_boundaries")
def phase_boundaries(spark, sf_dir):
    predictor = trajectory.fit_predictor(trajectory.features(sequences(spark, sf_dir)))
    prefixes = trajectory.prefix_features(calls(spark, sf_dir), "trial_id", ["ts", "event_id"]).withColumn("p_high", predictor.probability())
    return rounded(trajectory.phase_boundaries(prefixes, "trial_id").select("trial_id", "prefix_len", "tool", "phase_tag", "p_high"))


register("phase_changes", f"{CALLS}, t AS (SELECT trial_id, ts, event_id, CASE WHEN tool IN ('write_file', 'write_todos') THEN 'write' WHEN tool IN ({_TOOLS['e']}) THEN 'exec' WHEN tool IN ({_TOOLS['r']}) THEN 'read' WHEN tool = 'search_tool' THEN 'search' ELSE 'other' END AS phase_tag FROM calls), l AS (SELECT *, lag(phase_tag) OVER (PARTITION BY trial_id ORDER BY ts, event_id) AS b FROM t) SELECT phase_tag, count(*)::BIGINT AS n FROM l WHERE b <> phase_tag GROUP BY phase_tag", ep=False)(
    lambda spark, sf_dir: _phase_changes(calls(spark, sf_dir))
)


def _phase_changes(c: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    t = c.withColumn("phase_tag", trajectory.phase_tag(F.col("tool")))
    return t.withColumn("_b", F.lag("phase_tag").over(Window.partitionBy("trial_id").orderBy("ts", "event_id"))).where("_b <> phase_tag").groupBy("phase_tag").agg(F.count(F.lit(1)).alias("n"))


_BAG = "b AS (SELECT trial_id, tool, count(*) AS n FROM calls GROUP BY 1, 2), w AS (SELECT trial_id, tool, n / sqrt(sum(n * n) OVER (PARTITION BY trial_id)) AS weight FROM b)"
register("tool_weights", f"{CALLS}, {_BAG} SELECT trial_id, tool, round(weight, 6) AS weight FROM w", ep=False)(lambda spark, sf_dir: rounded(trajectory.tool_weights(sequences(spark, sf_dir), "trial_id")))
register(
    "most_similar",
    f"{_SEQ}, {_BAG}, d AS (SELECT q.trial_id AS query_id, w.trial_id, round(sum(w.weight * q.weight), 9) AS sim FROM w JOIN w q USING (tool) JOIN (SELECT trial_id FROM s WHERE user_id % 20 = 0) k ON k.trial_id = q.trial_id GROUP BY 1, 2), "
    "r AS (SELECT query_id, d.trial_id, sim, score, CASE WHEN score >= 0.5 THEN 'high' ELSE 'low' END AS outcome FROM d JOIN s ON s.trial_id = d.trial_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, outcome ORDER BY sim DESC, score, trial_id) AS rank FROM r) SELECT query_id, outcome, rank::INT AS rank, trial_id, round(sim, 6) AS similarity FROM o WHERE rank <= 3",
    ep=False,
)(lambda spark, sf_dir: _similar(sequences(spark, sf_dir)))


def _similar(s: DataFrame) -> DataFrame:
    queries = s.where("user_id % 20 = 0").withColumn("query_id", F.col("trial_id")).drop("trial_id")
    return rounded(retrieval.most_similar(queries, s).select("query_id", "outcome", "rank", "trial_id", "similarity"))


register(
    "recoverable_highs",
    f"{_SEQ}, m AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS outcome_class, bool_or(score < 0.5) OVER (PARTITION BY task_path) AS low FROM s) SELECT trial_id, outcome_class, outcome_class = 'high' AND low AS is_recoverable_high FROM m",
    ep=False,
)(lambda spark, sf_dir: trajectory.recoverable_highs(sequences(spark, sf_dir)).select("trial_id", "outcome_class", "is_recoverable_high"))
register(
    "retrieve_memories",
    f"{_SEQ}, {_BAG}, c AS (SELECT trial_id, coalesce(sum(n) FILTER (tool = 'read_file'), 0)::DOUBLE AS nr, coalesce(sum(n) FILTER (tool = 'write_file'), 0)::DOUBLE AS nw, sum(n * n)::DOUBLE AS ss FROM b GROUP BY 1), q AS (SELECT 1 / sqrt(2.0::DOUBLE) AS u), "
    "m AS (SELECT trial_id, score, (nr * u + nw * u) / sqrt(ss) AS similarity, (1 + contains(task_path, '5')::INT) / 3.0::DOUBLE AS task_match, score >= 0.75 AND bool_or(score < 0.5) OVER (PARTITION BY task_path) AS rh FROM s JOIN c USING (trial_id), q), "
    "f AS (SELECT *, (0.7::DOUBLE * similarity + 0.3::DOUBLE * task_match) * CASE WHEN rh THEN 1.3::DOUBLE ELSE 1 END AS final_score FROM m) "
    "SELECT row_number() OVER o::INT AS rank, trial_id, round(similarity, 6) AS similarity, round(task_match, 6) AS task_match, round(final_score, 6) AS final_score FROM f WINDOW o AS (ORDER BY final_score DESC, score DESC, rh DESC, trial_id) ORDER BY rank LIMIT 10",
    ep=False,
)(lambda spark, sf_dir: rounded(trajectory.retrieve(sequences(spark, sf_dir), "solve task 5", ["read_file", "write_file"], 10).select("rank", "trial_id", "similarity", "task_match", "final_score")))


def _asked(s: DataFrame) -> DataFrame:
    """The queries: trials of every twentieth user, with a task's words."""
    return s.where("user_id % 20 = 0").select(F.col("trial_id").alias("query_id"), F.concat(F.lit("Solve task "), (F.col("user_id") % 7).cast("string")).alias("description"), "tool_sequence")


_DOT = "dot AS (SELECT q.trial_id AS query_id, b.trial_id, sum(b.n * q.n) AS dot FROM b JOIN b q USING (tool) GROUP BY 1, 2), ss AS (SELECT trial_id, sum(n * n) AS ss FROM b GROUP BY 1)"
register(
    "retrieve_many",
    f"{_SEQ}, {_BAG}, {_DOT}, q AS (SELECT trial_id AS query_id, user_id % 7 AS d FROM s WHERE user_id % 20 = 0), "
    "r AS (SELECT *, score >= 0.75 AND bool_or(score < 0.5) OVER (PARTITION BY task_path) AS rh FROM s), "
    "m AS (SELECT q.query_id, r.trial_id, score, rh, round(coalesce(dot, 0) / sqrt((a.ss * z.ss)::DOUBLE), 12) AS similarity, (1 + contains(task_path, d::VARCHAR)::INT) / 3.0::DOUBLE AS task_match "
    "FROM q CROSS JOIN r JOIN ss a ON a.trial_id = q.query_id JOIN ss z ON z.trial_id = r.trial_id LEFT JOIN dot ON dot.query_id = q.query_id AND dot.trial_id = r.trial_id), "
    "f AS (SELECT *, round((0.7::DOUBLE * similarity + 0.3::DOUBLE * task_match) * CASE WHEN rh THEN 1.3::DOUBLE ELSE 1 END, 12) AS final_score FROM m), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, score DESC, rh DESC, trial_id)::INT AS rank FROM f) SELECT query_id, rank, trial_id, round(similarity, 6) AS similarity, round(task_match, 6) AS task_match, round(final_score, 6) AS final_score FROM o WHERE rank <= 5",
    ep=False,
)(lambda spark, sf_dir: _retrieved(sequences(spark, sf_dir)))


def _retrieved(s: DataFrame) -> DataFrame:
    found = retrieval.retrieve_many(trajectory.recoverable_highs(s), _asked(s))
    return rounded(found.select("query_id", "rank", "trial_id", "similarity", "task_match", "final_score"))


register(
    "checks_with_similar",
    f"{_SEQ}, {_BAG}, {_DOT}, r AS (SELECT d.query_id, d.trial_id, round(dot / sqrt((a.ss * z.ss)::DOUBLE), 12) AS sim, score, CASE WHEN score >= 0.5 THEN 'high' ELSE 'low' END AS outcome FROM dot d JOIN s ON s.trial_id = d.trial_id JOIN ss a ON a.trial_id = d.query_id JOIN ss z ON z.trial_id = d.trial_id WHERE d.query_id IN (SELECT trial_id FROM s WHERE user_id % 20 = 0)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id, outcome ORDER BY sim DESC, score, trial_id) AS rank FROM r) "
    "SELECT query_id, string_agg(trial_id, ' ' ORDER BY rank) FILTER (outcome = 'high') AS high, string_agg(trial_id, ' ' ORDER BY rank) FILTER (outcome = 'low') AS low FROM o WHERE rank <= 3 GROUP BY query_id",
    ep=False,
)(lambda spark, sf_dir: _checked(sequences(spark, sf_dir)))


def _checked(s: DataFrame) -> DataFrame:
    rows = trajectory.features(_asked(s))
    checked = trajectory.check(rows, trajectory.fit_predictor(trajectory.features(s)))
    found = retrieval.with_similar(checked, s)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["trial_id"]), " ")
    return found.select("query_id", names("similar_high").alias("high"), names("similar_low").alias("low"))
