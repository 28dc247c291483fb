"""Decomposition of unsolved tasks into sub-tasks along phase boundaries, level by level.

A level is a set of DataFrame operations over all tasks at once; there are at
most ``max_depth`` levels, and only stuck sub-tasks go on to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.functions.columns import basename
from episodeframe.lineage import cut


@dataclass
class RecursionConfig:
    max_depth: int = 3
    min_confidence: float = 0.70
    max_boundaries: int = 5
    decompose_stuck: bool = True
    decompose_recoverable: bool = True
    require_checkpoints: bool = False


def structural_boundaries(runs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(task, boundaries array in order) from the best run of each task.

    ``runs``: task, trial_id, score, ord.  ``boundaries``: trial_id, prefix_len,
    tool, phase_tag, confidence (of the monitor).
    """
    best = runs.groupBy("task").agg(F.max_by("trial_id", F.struct(F.col("score"), -F.col("ord"))).alias("trial_id"))
    return best.join(boundaries, "trial_id").groupBy("task").agg(F.array_sort(F.collect_list(F.struct(F.col("prefix_len").alias("exit_step"), "phase_tag", "confidence"))).alias("found"))


def align(profiles: DataFrame, found: DataFrame, checkpoints: DataFrame | None, config: RecursionConfig) -> DataFrame:
    """One row a (task, phase): entry, exit (-1 at the end), tag, weight, checkpoint.

    With checkpoints their number decides: surplus boundaries go, missing ones
    are made up behind the last (one step each); else every boundary but the
    closing one is a phase, of equal weight.
    """
    p = profiles.withColumn("_base", basename(F.col("task"))).join(found, "task", "left")
    if checkpoints is not None:
        specs = checkpoints.groupBy(F.col("task_name").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("index", "checkpoint_id", "reward_weight", "description", "condition_source"))).alias("specs"))
        p = p.join(specs, "_base", "left")
    else:
        p = p.withColumn("specs", F.lit(None).cast("array<struct<index:int,checkpoint_id:string,reward_weight:double,description:string,condition_source:string>>"))
    if config.require_checkpoints:
        p = p.where(F.col("specs").isNotNull())
    have = F.coalesce(F.size("found"), F.lit(0))
    n = F.when(F.col("specs").isNotNull(), F.size("specs")).otherwise(have)
    p = p.withColumn("n_phases", n).where(F.col("n_phases") >= 1)
    last = F.coalesce(F.try_element_at("found", F.lit(-1))["exit_step"], F.lit(10))
    exit_of = lambda i: F.when(i < have, F.get("found", i)["exit_step"]).otherwise(last + (i - have) + 1)
    rows = p.select("*", F.explode(F.sequence(F.lit(0), F.col("n_phases") - 1)).alias("phase"))
    i, spec = F.col("phase"), F.get("specs", F.col("phase"))
    sub_id = F.concat(F.col("task"), F.lit("::phase-"), i.cast("string"))
    tag = F.coalesce(F.get("found", i)["phase_tag"], F.lit("unknown"))
    return rows.select(
        "task", "scores", "difficulty", "kind", "phase", "n_phases", sub_id.alias("sub_task_id"),
        F.when(i == 0, F.lit(0)).otherwise(exit_of(i - 1)).alias("entry_step"), F.when(i == F.col("n_phases") - 1, F.lit(-1)).otherwise(exit_of(i + 1)).alias("exit_step"),
        tag.alias("phase_tag"), F.coalesce(spec["reward_weight"], 1.0 / F.col("n_phases")).alias("weight"), F.coalesce(spec["reward_weight"], F.lit(0.0)).alias("reward_delta"),
        F.coalesce(spec["checkpoint_id"], sub_id).alias("checkpoint_id"), spec["condition_source"].alias("condition_source"), F.when(spec.isNotNull(), "checkpoint").otherwise("structural").alias("source"),
        F.when(F.coalesce(spec["description"], F.lit("")) != "", F.concat(F.lit("Complete phase '"), spec["description"], F.lit("' for task "), F.col("task"))).otherwise(F.concat(F.lit("Complete the "), tag, F.lit(" phase of task "), F.col("task"))).alias("instruction"),
    )


def sub_task_profiles(phases: DataFrame, depth: int) -> DataFrame:
    """Scores of sub-tasks from the parent's totals: a phase is passed where the total reaches its cumulative weight."""
    run = Window.partitionBy("task").orderBy("phase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = phases.withColumn("_cum", F.sum("weight").over(run))
    df = df.withColumn("sub_scores", F.transform("scores", lambda s: F.when(s >= F.col("_cum") - 1e-6, F.col("weight")).otherwise(0.0)))
    df = df.withColumns({"q_star": F.array_max("sub_scores"), "q_bar": F.aggregate("sub_scores", F.lit(0.0), lambda a, s: a + s) / F.size("sub_scores")})
    gap = F.col("q_star") - F.col("q_bar")
    kind = F.when(F.col("q_star") == 0, "stuck").when(gap < 1e-9, "solid").otherwise("recoverable")
    return df.select(
        F.col("task").alias("parent_task"), "sub_task_id", "phase", "entry_step", "exit_step", "phase_tag", "weight", "reward_delta", "checkpoint_id", "condition_source", "source", "instruction", "difficulty", F.col("kind").alias("parent_kind"),
        F.col("sub_scores").alias("scores"), "q_star", "q_bar", gap.alias("gap"), kind.alias("kind"), F.lit(depth).alias("sub_task_depth"),
    )


def decompose(profiles: DataFrame, found: DataFrame, checkpoints: DataFrame | None = None, config: RecursionConfig | None = None) -> DataFrame:
    """All sub-tasks of unsolved tasks, to ``max_depth``, with ``recursively_stuck`` where all siblings are stuck and go no deeper."""
    config = config or RecursionConfig()
    found = cut(found)
    kinds = [k for k, on in (("stuck", config.decompose_stuck), ("recoverable", config.decompose_recoverable)) if on]
    level = profiles.where(F.col("kind").isin(*kinds)).select("task", "scores", "difficulty", "kind")
    bounds, out = found, None
    for depth in range(1, config.max_depth + 1):
        subs = cut(sub_task_profiles(align(level, bounds, checkpoints if depth == 1 else None, config), depth))
        out = subs if out is None else out.unionByName(subs)
        # A stuck sub-task is cut where boundaries of its parent's run lie inside it.
        inner = subs.where("kind = 'stuck'").select(F.col("sub_task_id").alias("task"), "parent_task", "entry_step", "exit_step")
        inside = inner.join(bounds.withColumnRenamed("task", "parent_task"), "parent_task").select("task", F.filter("found", lambda b: (b["exit_step"] > F.col("entry_step")) & ((F.col("exit_step") < 0) | (b["exit_step"] < F.col("exit_step")))).alias("found"))
        bounds = inside.where(F.size("found") >= 2)
        level = subs.where("kind = 'stuck'").select(F.col("sub_task_id").alias("task"), "scores", "difficulty", "kind")
    parents = out.select(F.col("parent_task").alias("sub_task_id")).distinct().withColumn("_deeper", F.lit(True))
    out = out.join(parents, "sub_task_id", "left").withColumn("_deeper", F.coalesce("_deeper", F.lit(False)))
    all_stuck = F.bool_and((F.col("kind") == "stuck") & ~F.col("_deeper")).over(Window.partitionBy("parent_task"))
    return out.withColumn("recursively_stuck", all_stuck).drop("_deeper")


def recursive_gaps(sub_tasks: DataFrame, max_depth: int = 3) -> DataFrame:
    """(task, recursive_gap): weighted sum of the gaps of unsolved sub-tasks, from the deepest level up."""
    now = sub_tasks.select("parent_task", F.col("sub_task_id").alias("task"), "weight", "kind", "gap", "sub_task_depth")
    deeper = None
    for depth in range(max_depth, 0, -1):
        level = now.where(F.col("sub_task_depth") == depth)
        if deeper is not None:
            level = level.join(deeper, "task", "left").withColumn("gap", F.coalesce("recursive_gap", "gap")).drop("recursive_gap")
        sums = level.groupBy(F.col("parent_task").alias("task")).agg(F.sum(F.when(F.col("kind") != "solid", F.col("weight") * F.col("gap")).otherwise(0.0)).alias("recursive_gap"))
        deeper = sums
    return deeper


def edges(sub_tasks: DataFrame) -> DataFrame:
    return sub_tasks.select(F.col("parent_task").alias("parent"), F.col("sub_task_id").alias("child"))


def to_json(sub_tasks: DataFrame) -> DataFrame:
    """The graph as one JSON document for each parent task."""
    fields = [c for c in sub_tasks.columns if c != "parent_task"]
    return sub_tasks.groupBy("parent_task").agg(F.to_json(F.struct(F.first("parent_task").alias("parent_task"), F.array_sort(F.collect_list(F.struct("phase", *[c for c in fields if c != "phase"]))).alias("sub_tasks"))).alias("graph"))
