"""Solid / recoverable / stuck: what an agent's repeated attempts at a task tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.functions.columns import known_keys
from episodeframe.operators.scans import Running, running

REINFORCE, BINS = 0.9, 5


def task_profiles(df: DataFrame, by: list[str] = ("model",), threshold: float = REINFORCE, order: str = "ord") -> DataFrame:
    """One row for each (keys, task): n_attempts, q_star, q_bar, difficulty, gap, kind, consistency, n_reinforce, n_contrast, outcome_entropy, priority, priority_eig.

    Everything comes from the distribution table, so a task may have any number
    of attempts; the attempts themselves are rows of ``attempts``.  Attempts
    without a score count for ``n_attempts`` only; the difficulty is that of the
    first attempt in ``order``.
    """
    keys = [*by, "task"]
    rows = known_keys(df, keys)
    difficulty = F.col("s_difficulty") if "s_difficulty" in df.columns else F.lit(None).cast("string")
    place = F.col(order) if order in df.columns else F.lit(0)
    dist = rows.groupBy(*keys, "score", difficulty.alias("difficulty")).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    scored = F.when(F.col("score").isNotNull(), F.col("_n"))
    whole = dist.groupBy(*keys).agg(
        F.sum("_n").alias("n_attempts"), F.sum(scored).alias("_scored"), F.max("score").alias("q_star"), F.min("score").alias("_low"),
        (F.sum(F.col("score") * F.col("_n")) / F.sum(scored)).alias("q_bar"), F.min_by("difficulty", "_first").alias("difficulty"),
    )
    both = dist.drop("difficulty", "_first").join(whole, keys)
    step = (F.col("q_star") - F.col("_low")) / BINS
    edge = lambda i: F.col("_low") + i * step
    inside = lambda i: (F.col("score") >= edge(i)) & ((F.col("score") <= F.col("q_star")) if i == BINS - 1 else (F.col("score") < edge(i + 1)))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    high = F.col("score") >= F.lit(threshold) * F.col("q_star")
    some = F.col("q_star") > 0
    g = both.groupBy(*keys, *(c for c in whole.columns if c not in keys)).agg(
        count(some & high).cast("int").alias("n_reinforce"), count(some & ~high).cast("int").alias("n_contrast"), *(count(inside(i)).alias(f"_b{i}") for i in range(BINS))
    )
    total = F.lit(0.0)
    for i in range(BINS):
        share = F.col(f"_b{i}") / F.col("_scored")
        total = total - F.when(share > 0, share * F.log(share)).otherwise(0.0)
    entropy = F.when((F.col("_scored") < 2) | (F.col("_low") == F.col("q_star")), F.lit(0.0)).otherwise(total)
    gap = F.col("q_star") - F.col("q_bar")
    kind = F.when(F.col("q_star") == 0, "stuck").when(gap < 1e-9, "solid").otherwise("recoverable")
    kappa = F.when(F.col("kind") == "stuck", 0.0).when(F.col("kind") == "solid", 1.0).otherwise(F.col("q_bar") / F.col("q_star"))
    g = g.withColumns({"gap": gap, "kind": kind, "outcome_entropy": entropy}).withColumn("consistency", kappa)
    g = g.withColumns({"priority": F.col("gap") * (1 - F.col("consistency")), "priority_eig": F.col("outcome_entropy") * (1 - F.col("consistency"))})
    return g.select(*keys, "n_attempts", "q_star", "q_bar", "difficulty", "gap", "kind", "consistency", "n_reinforce", "n_contrast", "outcome_entropy", "priority", "priority_eig")


def attempts(df: DataFrame, by: list[str] = ("model",), threshold: float = REINFORCE, order: str = "ord") -> DataFrame:
    """One row for each attempt: keys, task, attempt (from 0, in ``order``), score, residual to the best, reinforce (null for stuck tasks).

    Numbered by a scan, so one task's attempts may spread over many partitions.
    """
    keys = [*by, "task"]
    numbered = running(known_keys(df, keys), [order], keys, {"_i": Running("count")})
    best = known_keys(df, keys).groupBy(*keys).agg(F.max("score").alias("_best"))
    both = numbered.join(best, keys)
    return both.select(*keys, (F.col("_i") - 1).alias("attempt"), "score", (F.col("_best") - F.col("score")).alias("residual"), F.when(F.col("_best") > 0, F.col("score") >= F.lit(threshold) * F.col("_best")).alias("reinforce"))


def with_scores(profiles: DataFrame, df: DataFrame, by: list[str] = ("model",), order: str = "ord") -> DataFrame:
    """Profiles with ``scores``, the attempts' scores in order: for plans of one agent, whose tasks have few attempts each."""
    keys = [*by, "task"]
    lists = known_keys(df, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("score").alias("s")))), lambda x: x["s"]).alias("scores"))
    return profiles.join(lists, keys)


def right_tail(profiles: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Counts, sums and the consistency index of each agent."""
    n = lambda kind: F.sum((F.col("kind") == kind).cast("bigint"))
    g = profiles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("n_attempts").alias("n_episodes"),
        n("solid").alias("n_solid"),
        n("recoverable").alias("n_recoverable"),
        n("stuck").alias("n_stuck"),
        F.sum("gap").alias("total_gap"),
        F.sum("q_star").alias("sum_q_star"),
        F.sum("q_bar").alias("sum_q_bar"),
    )
    return g.select("*", (F.col("n_recoverable") / F.col("n_tasks")).alias("pct_recoverable"), F.when(F.col("sum_q_star") > 0, F.col("sum_q_bar") / F.col("sum_q_star")).otherwise(1.0).alias("consistency_index"))


def priorities(profiles: DataFrame, n: int | None = None) -> DataFrame:
    """Recoverable tasks, largest gap first; ties by task."""
    out = profiles.where("kind = 'recoverable'").orderBy(F.desc("gap"), "task")
    return out.limit(n) if n is not None else out


def compare_agents(profiles: DataFrame) -> DataFrame:
    """Leaderboard by consistency index, rounded for reading."""
    r = right_tail(profiles)
    places = {"pct_recoverable": 3, "total_gap": 4, "sum_q_star": 4, "sum_q_bar": 4, "consistency_index": 4}
    return r.select("model", "n_tasks", "n_recoverable", *(F.round(c, d).alias(c) for c, d in places.items())).orderBy(F.desc("consistency_index"), "model")
