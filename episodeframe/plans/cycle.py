"""One improvement cycle: episodes and trajectories in, an ordered training plan out.

Everything stays a lazy table; ``Cycle`` only names the tables that belong
together.  An agent's attempts are all rows of ``eps``, whatever their model.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.functions.columns import basename
from episodeframe.operators import pool as pools
from episodeframe.operators import taxonomy, trajectory
from episodeframe.plans import curriculum, recursion
from episodeframe.plans.cyclelog import CycleLog

_NO_RUNS = "task_path string, score double, traj_path string"


@dataclass(frozen=True)
class Cycle:
    """``plan``: a row a recoverable task, in training order; ``overview``: one row."""

    overview: DataFrame
    plan: DataFrame
    profiles: DataFrame
    sub_tasks: DataFrame | None = None
    cross_agent_pairs: DataFrame | None = None


def monitored_prefixes(runs: DataFrame) -> DataFrame:
    """Every prefix of every run (trial_id, tool_sequence, score) with what a predictor fitted on the runs says of it."""
    predictor = trajectory.fit_predictor(trajectory.features(runs))
    calls = runs.select("trial_id", F.posexplode("tool_sequence").alias("pos", "tool"))
    prefixes = trajectory.prefix_features(calls, "trial_id", ["pos"]).withColumn("n_steps", F.col("prefix_len"))
    return trajectory.check(prefixes, predictor)


def divergences(pairs: DataFrame, runs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(task, divergence_step): where the monitor first tells the best and the lowest run of a task apart."""
    first = pairs.groupBy("task").agg(F.min(F.struct("contrast_score", "contrast_path", "reinforce_path")).alias("p"))
    trials = runs.select("traj_path", "trial_id").dropDuplicates(["traj_path"])
    sides = []
    for side in ("reinforce_path", "contrast_path"):
        ids = first.select("task", F.col(f"p.{side}").alias("traj_path")).join(trials, "traj_path").select("task", "trial_id")
        sides.append(prefixes.select("trial_id", "prefix_len", "p_high").join(ids, "trial_id"))
    return trajectory.divergence_steps(*sides, "task").groupBy("task").agg(F.min("prefix_len").cast("int").alias("divergence_step"))


def attach_sub_tasks(plan: DataFrame, sub_tasks: DataFrame) -> DataFrame:
    """Adds ``sub_tasks``: those directly below a planned task, in order of their phase; a task has as many as its phases."""
    consistency = F.when(F.col("kind") == "stuck", 0.0).when(F.col("kind") == "solid", 1.0).otherwise(F.col("q_bar") / F.col("q_star"))
    text = F.format_string("%s (steps %d to %d, worth %.3f).", "instruction", "entry_step", "exit_step", "reward_delta")
    item = F.struct(
        "phase", F.col("sub_task_id").alias("task"), F.lit("decomposed").alias("kind"), "q_star", "q_bar", consistency.alias("consistency"), "gap", (F.col("gap") * (1 - consistency)).alias("priority"), text.alias("recommendation"),
    )
    below = sub_tasks.select(F.col("parent_task").alias("task"), item.alias("item")).groupBy("task").agg(F.array_sort(F.collect_list("item")).alias("sub_tasks"))
    return plan.join(below, "task", "left")


def run_cycle(
    eps: DataFrame,
    runs: DataFrame | None = None,
    cycle: int = 1,
    agent: str = "agent",
    model: str = "unknown",
    name_map: dict[str, str] | None = None,
    by_information: bool = False,
    simulated: DataFrame | None = None,
    recursive: recursion.RecursionConfig | None = None,
    checkpoints: DataFrame | None = None,
    log: CycleLog | None = None,
) -> Cycle:
    """Observe, localise, order, predict and, with ``recursive``, decompose.

    ``runs`` (task_path, trial_id, score, tool_sequence, traj_path) are the
    trajectories; without them tasks have no pairs, no divergence step and, with
    ``checkpoints`` only, phases from these.  No episodes give an empty plan and
    an overview of zeros with consistency 1.
    """
    spark = eps.sparkSession
    profiles = taxonomy.task_profiles(eps, by=[])
    report = taxonomy.right_tail(profiles, by=[]).na.fill(0)
    pairs = curriculum.training_pairs(runs if runs is not None else spark.createDataFrame([], _NO_RUNS), profiles, name_map=name_map)
    plan = curriculum.build_plan(profiles, pairs, by_information)
    if simulated is not None:
        plan = curriculum.predicted_gains(plan.drop("predicted_gain", "gain_low", "gain_high"), simulated=simulated)
    has_runs = runs is not None and not runs.isEmpty()
    prefixes = monitored_prefixes(runs) if has_runs else None
    if has_runs:
        plan = plan.join(divergences(pairs, runs, prefixes), "task", "left").withColumn("divergence_step", F.coalesce("divergence_step", F.lit(0)))
    else:
        plan = plan.withColumn("divergence_step", F.lit(0))
    subs, n_sub = None, 0
    if recursive is not None:
        subs = recursion.decompose(taxonomy.with_scores(profiles, eps, by=[]), _found(profiles, runs if has_runs else None, prefixes), checkpoints, recursive)
        plan, n_sub = attach_sub_tasks(plan, subs), subs.count()
    summary = curriculum.plan_summary(plan, report)
    about = {"agent": F.lit(agent), "model": F.lit(model), "cycle": F.lit(cycle), "n_trajectories": F.lit(runs.count() if has_runs else 0), "recursive": F.lit(recursive is not None), "n_decomposed": F.lit(n_sub)}
    score_left = F.col("sum_q_star") - F.col("sum_q_bar")
    overview = summary.select(*(c.alias(n) for n, c in about.items()), *summary.columns, score_left.alias("recoverable_score_left"))
    if log is not None:
        log.append(cycle, profiles, plan)
    return Cycle(overview, plan, profiles, subs)


def _found(profiles: DataFrame, runs: DataFrame | None, prefixes: DataFrame | None) -> DataFrame:
    """Phase boundaries of each task's best run; runs meet tasks on the last part of their path."""
    if runs is None:
        return profiles.sparkSession.createDataFrame([], "task string, found array<struct<exit_step:int,phase_tag:string,confidence:double>>")
    marks = trajectory.phase_boundaries(prefixes, "trial_id").withColumn("prefix_len", F.col("prefix_len").cast("int"))
    names = profiles.select("task", basename(F.col("task")).alias("name"))
    named = runs.select(basename(F.col("task_path")).alias("name"), "trial_id", "score").join(names, "name")
    # Which of several best runs is taken follows from its name alone.
    order = F.shiftright(F.xxhash64("trial_id"), 1)
    return recursion.structural_boundaries(named.select("task", "trial_id", "score", order.alias("ord")), marks)


def attach_cross_agent_pairs(cycle: Cycle, pool: DataFrame, min_gap: float = 0.1) -> Cycle:
    """The cycle with the pool's pairs of agents."""
    return replace(cycle, cross_agent_pairs=pools.cross_agent_pairs(pool, min_gap))


def contribute(pool: DataFrame | None, eps: DataFrame, agent: str) -> DataFrame:
    """The pool and this agent's episodes."""
    own = pools.from_episodes(eps, agent)
    return own if pool is None else pool.unionByName(own, allowMissingColumns=True)


def document(cycle: Cycle, most: int = 100_000) -> dict:
    """The cycle as one JSON document; a plan of more than ``most`` tasks is an error (write ``cycle.plan`` instead)."""
    n = cycle.plan.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a document has at most {most} tasks")
    lines = cycle.plan.orderBy("position").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
    head = json.loads(cycle.overview.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).head()[0])
    out = {**head, "curriculum": [json.loads(r[0]) for r in lines]}
    if cycle.cross_agent_pairs is not None:
        out["cross_agent_pairs"] = [json.loads(r[0]) for r in cycle.cross_agent_pairs.limit(most).select(F.to_json(F.struct("*"))).collect()]
    return out


def plan_text(cycle: Cycle, n: int = 20) -> str:
    """The overview and the first ``n`` tasks, for reading."""
    o = cycle.overview.head()
    gain = "unknown" if o["predicted_total"] is None else f"{o['predicted_total']:.3f}"
    lines = [
        f"{o['agent']} ({o['model']}), cycle {o['cycle']}: {o['n_tasks']} tasks, consistency {o['consistency_index']:.3f}",
        f"solid {o['n_solid']}, recoverable {o['n_recoverable']}, stuck {o['n_stuck']}; predicted gain {gain}",
    ]
    rows = cycle.plan.orderBy("position").limit(n).select("position", "task", "gap", "recommendation").collect()
    return "\n".join([*lines, *(f"{r['position']:>3}. {r['task']}  gap {r['gap']:.3f}  {r['recommendation']}" for r in rows)])
