"""Robust centre, tail risk and reliability of score distributions.

Quantile statistics work on the *distribution table* ``(keys, score, n)``: a
partial aggregate shrinks the episodes to one row per different score before
anything is shuffled, and quantiles, tail means and variances come from the
counts.  Quantiles are exact at any number of different values (``quantiles``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodeframe.functions.columns import known_keys, pass_at, pass_hat
from episodeframe.operators.quantiles import quantiles
from episodeframe.operators.scans import Running, running


def distribution(df: DataFrame, by: list[str] = (), value: str = "score") -> DataFrame:
    return known_keys(df, by).where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def _with(dist: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Group values beside every row of their group; the optimiser picks the join."""
    return dist.join(small, list(by)) if by else dist.crossJoin(small)


def _mean_where(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("score") * F.col("n"))) / F.sum(F.when(cond, F.col("n")))


def iqm(df: DataFrame, by: list[str] = (), value: str = "score") -> DataFrame:
    """Mean of the values between the quartiles, both included."""
    dist = distribution(df, by, value)
    both = _with(dist, quantiles(dist, by, {"_lo": 0.25, "_hi": 0.75}), by)
    return both.groupBy(*by).agg(_mean_where(F.col("score").between(F.col("_lo"), F.col("_hi"))).alias("iqm"))


def value_at_risk(df: DataFrame, by: list[str] = (), alpha: float = 0.1, tail: str = "lower") -> DataFrame:
    return quantiles(distribution(df, by), by, {"var": alpha if tail == "lower" else 1 - alpha})


def cvar(df: DataFrame, by: list[str] = (), alpha: float = 0.1, tail: str = "lower") -> DataFrame:
    """Mean of the tail up to its quantile, the quantile included."""
    dist = distribution(df, by)
    both = _with(dist, quantiles(dist, by, {"_v": alpha if tail == "lower" else 1 - alpha}), by)
    inside = F.col("score") <= F.col("_v") if tail == "lower" else F.col("score") >= F.col("_v")
    return both.groupBy(*by).agg(_mean_where(inside).alias("cvar"))


def task_counts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(keys, task, n, c): trials and successes; tasks of all models pool unless ``by`` tells them apart."""
    return known_keys(df, [*by, "task"]).groupBy(*by, "task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("success").cast("bigint")).alias("c"))


def pass_curve(df: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8), by: list[str] = ()) -> DataFrame:
    """(keys, k, pass_at_k, pass_hat_k): one aggregate of the episodes for all k."""
    counts = task_counts(df, by)
    n, c = F.col("n"), F.col("c")
    wide = counts.groupBy(*by).agg(*(F.avg(f(n, c, F.lit(k))).alias(f"{name}{k}") for k in ks for name, f in (("_a", pass_at), ("_h", pass_hat))))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_a{k}").alias("pass_at_k"), F.col(f"_h{k}").alias("pass_hat_k")) for k in ks))
    return wide.select(*by, F.inline(rows))


def reliability_decay(df: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8), by: list[str] = ()) -> DataFrame:
    """(keys, slope, total_drop) of pass^k over k, from its finite points."""
    curve = pass_curve(df, ks, by).where(F.col("pass_hat_k").isNotNull() & ~F.isnan("pass_hat_k"))
    out = curve.groupBy(*by).agg(F.regr_slope("pass_hat_k", "k").alias("slope"), F.min_by("pass_hat_k", "k").alias("_first"), F.max_by("pass_hat_k", "k").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return out.select(*by, "slope", F.when(F.col("_n") >= 2, F.col("_first") - F.col("_last")).alias("total_drop"))


def variance_amplification(df: DataFrame, short: Column, long: Column, by: list[str] = ()) -> DataFrame:
    """Sample variance of long-horizon scores over that of short ones; null where undefined."""
    agg = known_keys(df, by).groupBy(*by).agg(F.var_samp(F.when(short, F.col("score"))).alias("_s"), F.var_samp(F.when(long, F.col("score"))).alias("_l"))
    return agg.select(*by, F.when(F.col("_s") != 0, F.col("_l") / F.col("_s")).alias("vaf"))


def optimality_gap(df: DataFrame, by: list[str] = (), optimal: float = 1.0) -> DataFrame:
    if optimal == 0:
        raise ValueError("optimal score must be non-zero")
    return known_keys(df, by).groupBy(*by).agg(((F.lit(optimal) - F.avg("score")) / F.lit(optimal)).alias("optimality_gap"))


def summarize(df: DataFrame, by: list[str] = (), alpha: float = 0.1, ks: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """n_episodes, mean, iqm, median, std, var_a, cvar_a, success_rate, pass_at_<k>, pass_hat_<k>.

    Two aggregates of the episodes: one per different score, one per task.
    """
    clean = known_keys(df, by)
    dist = clean.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("success").cast("bigint")).alias("_won"))
    q = dist.groupBy(*by).agg(
        F.sum("n").alias("n_episodes"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"),
        (F.sum("_won") / F.sum("n")).alias("success_rate"),
    )
    # A null score counts as an episode but has no rank.
    ranked = dist.where(F.col("score").isNotNull())
    ends = quantiles(ranked, by, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75, "_qa": alpha})
    both = _with(dist, _with(q, ends, by), by)
    tails = both.groupBy(*by).agg(
        F.first("n_episodes").alias("n_episodes"),
        F.first("mean").alias("mean"),
        _mean_where(F.col("score").between(F.col("_q1"), F.col("_q3"))).alias("iqm"),
        F.first("_q2").alias("median"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("score") - F.col("mean"), 2)) / F.greatest(F.first("n_episodes") - 1, F.lit(1))).alias("std"),
        F.first("_qa").alias("var_a"),
        _mean_where(F.col("score") <= F.col("_qa")).alias("cvar_a"),
        F.first("success_rate").alias("success_rate"),
    )
    n, c = F.col("n"), F.col("c")
    passes = task_counts(df, by).groupBy(*by).agg(*(e for k in ks for e in (F.avg(pass_at(n, c, F.lit(k))).alias(f"pass_at_{k}"), F.avg(pass_hat(n, c, F.lit(k))).alias(f"pass_hat_{k}"))))
    return _with(tails, passes, by)


def performance_profile(df: DataFrame, taus: list[float] | None = None, by: list[str] = (), points: int = 50) -> DataFrame:
    """(keys, tau, fraction of scores >= tau); by default ``points`` equal steps over each group's range.

    The thresholds are counted by running sums over the distribution table.
    """
    dist = distribution(df, by)
    if taus is None:
        ends = dist.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        grid = ends.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(i == points - 1, F.col("_hi")).otherwise(F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / (points - 1))))).alias("tau"))
    else:
        grid = dist.select(*by).distinct().select(*by, F.explode(F.array(*(F.lit(float(t)) for t in taus))).alias("tau")) if by else df.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    return _cumulative(dist, grid, by, "tau", upper=True).select(*by, "tau", "fraction")


def _cumulative(dist: DataFrame, grid: DataFrame, by: list[str], at: str, upper: bool) -> DataFrame:
    """For each grid point the share of the group's rows at or above (below) it, by one running sum over ranges of values."""
    points = grid.select(*by, F.col(at).alias("_x"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("_point"))
    values = dist.select(*by, F.col("score").alias("_x"), "n", F.lit(0).alias("_point"))
    order = F.col("_x").desc() if upper else F.col("_x").asc()
    both = running(points.unionByName(values), [order, "_point"], list(by), {"_cum": Running("sum", F.col("n"))})
    whole = dist.groupBy(*by).agg(F.sum("n").alias("_all"))
    return _with(both.where("_point = 1"), whole, by).select(*by, F.col("_x").alias(at), (F.col("_cum") / F.col("_all")).alias("fraction"))


def ecdf(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(keys, score, cdf): one row for each different score."""
    dist = distribution(df, by)
    run = running(dist, ["score"], list(by), {"_cum": Running("sum", F.col("n"))})
    return _with(run, dist.groupBy(*by).agg(F.sum("n").alias("_all")), by).select(*by, "score", (F.col("_cum") / F.col("_all")).alias("cdf"))


def meta_distribution(df: DataFrame, stat: Column, run: str = "run_id", ci: float = 0.95, by: list[str] = ()) -> DataFrame:
    """Distribution of an aggregate ``stat`` over runs: n_repeats, mean, std, lo, hi, spread."""
    per_run = known_keys(df, [*by, run]).groupBy(*by, run).agg(stat.alias("stat"))
    tail = (1 - ci) / 2
    g = per_run.groupBy(*by).agg(F.count(F.lit(1)).alias("n_repeats"), F.avg("stat").alias("mean"), F.coalesce(F.stddev_samp("stat"), F.lit(0.0)).alias("std"), (F.max("stat") - F.min("stat")).alias("spread"))
    ends = quantiles(distribution(per_run, by, "stat"), by, {"lo": tail, "hi": 1 - tail})
    return _with(g, ends, by).select(*by, "n_repeats", "mean", "std", "lo", "hi", "spread")


def gap_is_real(df: DataFrame, a: Column, b: Column, stat: Column, run: str = "run_id") -> DataFrame:
    """Repeats of A and B paired by position: share where A is strictly better, and whether their ranges overlap."""
    from pyspark.sql import Window

    side = F.when(a, F.lit("a")).when(b, F.lit("b"))
    runs = df.withColumn("_side", side).where(F.col("_side").isNotNull()).groupBy("_side", run).agg(stat.alias("stat"))
    nth = runs.withColumn("_i", F.row_number().over(Window.partitionBy("_side").orderBy(run)))
    paired = nth.groupBy("_i").agg(F.max(F.when(F.col("_side") == "a", F.col("stat"))).alias("_a"), F.max(F.when(F.col("_side") == "b", F.col("stat"))).alias("_b"))
    return paired.agg(
        F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).cast("bigint").alias("n_pairs"),
        F.avg(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.col("_a") > F.col("_b")).cast("double"))).alias("p_a_better"),
        ((F.min("_a") <= F.max("_b")) & (F.min("_b") <= F.max("_a"))).alias("ranges_overlap"),
    )


def reduce_scores(df: DataFrame, value: str = "score", alpha: float = 0.1) -> DataFrame:
    """One row: n, n_missing, mean (0 when empty), iqm, std, var_a, cvar_a, min, frac_zero."""
    dist = distribution(df, [], value)
    missing = df.agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col(value).isNull().cast("bigint")).alias("n_missing"))
    q = quantiles(dist, [], {"_lo": 0.25, "_hi": 0.75, "_v": alpha})
    s = dist.crossJoin(q).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("score") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean"),
        _mean_where(F.col("score").between(F.col("_lo"), F.col("_hi"))).alias("iqm"),
        F.sqrt((F.sum(F.col("n") * F.col("score") * F.col("score")) - F.pow(F.sum(F.col("n") * F.col("score")), 2) / F.sum("n")) / F.greatest(F.sum("n") - 1, F.lit(1))).alias("std"),
        F.first("_v").alias("var_a"),
        _mean_where(F.col("score") <= F.col("_v")).alias("cvar_a"),
        F.min("score").alias("min"),
        (F.sum(F.when(F.col("score") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("frac_zero"),
    )
    return s.crossJoin(missing.select(F.coalesce("n_missing", F.lit(0)).alias("n_missing")))


def grouping_summary(df: DataFrame, strata: list[str]) -> DataFrame:
    """Count, mean and success rate overall and for each stratum, by GROUPING SETS in one pass."""
    if not strata:
        return df.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    sets = [[], *([F.col(s)] for s in strata)]
    return df.groupingSets(sets, *(F.col(s) for s in strata)).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg(F.col("success").cast("double")).alias("success_rate"))
