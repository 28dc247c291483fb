"""Two samples of outcomes against each other.

Everything comes from one table ``(keys, score, n_a, n_b)``: counts of each
different score in A and B.  Running sums over it give both CDFs, so no pair of
episodes is ever formed.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.functions import special
from episodeframe.functions.columns import known_keys


def two_sample_counts(df: DataFrame, a: Column, b: Column, by: list[str] = (), value: str = "score") -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return known_keys(df, by).where((a | b) & F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("score")).agg(one(a).alias("n_a"), one(b).alias("n_b"))


def cumulative(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds cum_a, cum_b (rows up to the score), tot_a, tot_b and the next score."""
    keys = list(by) or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy("score")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return counts.select(
        "*",
        F.sum("n_a").over(run).alias("cum_a"),
        F.sum("n_b").over(run).alias("cum_b"),
        F.sum("n_a").over(whole).alias("tot_a"),
        F.sum("n_b").over(whole).alias("tot_b"),
        F.lead("score").over(order).alias("next_score"),
    )


def distances(df: DataFrame, a: Column, b: Column, by: list[str] = (), value: str = "score") -> DataFrame:
    """(keys, n_a, n_b, wasserstein, ks_d, prob_improvement, mwu_u, tie_term)."""
    c = cumulative(two_sample_counts(df, a, b, by, value), by)
    fa, fb = F.col("cum_a") / F.col("tot_a"), F.col("cum_b") / F.col("tot_b")
    both = F.col("n_a") + F.col("n_b")
    ahead = F.sum(F.col("n_a") * (F.col("cum_b") - F.col("n_b") + F.col("n_b") / 2))
    return c.groupBy(*by).agg(
        F.first("tot_a").alias("n_a"),
        F.first("tot_b").alias("n_b"),
        F.coalesce(F.sum(F.abs(fa - fb) * (F.col("next_score") - F.col("score"))), F.lit(0.0)).alias("wasserstein"),
        F.max(F.abs(fa - fb)).alias("ks_d"),
        (ahead / F.when((F.first("tot_a") > 0) & (F.first("tot_b") > 0), F.first("tot_a") * F.first("tot_b"))).alias("prob_improvement"),
        ahead.alias("mwu_u"),
        F.sum((both * both * both - both).cast("double")).alias("tie_term"),
    )


def effect_size(df: DataFrame, a: Column, b: Column, by: list[str] = (), value: str = "score") -> DataFrame:
    """Cohen's d; 0 where a variance is missing or both are 0."""
    x = lambda c: F.when(c, F.col(value))
    g = known_keys(df, by).groupBy(*by).agg(F.avg(x(a)).alias("_ma"), F.avg(x(b)).alias("_mb"), F.var_samp(x(a)).alias("_va"), F.var_samp(x(b)).alias("_vb"))
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    return g.select(*by, F.when(pooled > 0, (F.col("_ma") - F.col("_mb")) / pooled).otherwise(0.0).alias("effect_size"))


def dominance(df: DataFrame, a: Column, b: Column, by: list[str] = (), grid: int = 200, tol: float = 1e-9, value: str = "score") -> DataFrame:
    """First- and second-order stochastic dominance in both directions, on an equal grid over the pooled range."""
    counts = two_sample_counts(df, a, b, by, value)
    keys = list(by) or [F.lit(0)]
    ends = counts.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (grid - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.when(i == grid - 1, F.col("_hi")).otherwise(F.col("_lo") + i * step))
    points = ends.select(*by, F.explode(at).alias("_x"), step.alias("_dx"), F.lit(0).cast("bigint").alias("n_a"), F.lit(0).cast("bigint").alias("n_b"), F.lit(1).alias("_p"))
    rows = counts.select(*by, F.col("score").alias("_x"), F.lit(None).cast("double").alias("_dx"), "n_a", "n_b", F.lit(0).alias("_p"))
    run = Window.partitionBy(*keys).orderBy("_x", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    share = lambda n: F.sum(n).over(run) / F.sum(n).over(whole)
    f = points.unionByName(rows).withColumns({"_fa": share("n_a"), "_fb": share("n_b")}).where("_p = 1")
    area = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = f.withColumns({"_ia": F.sum("_fa").over(area) * F.col("_dx"), "_ib": F.sum("_fb").over(area) * F.col("_dx")})
    every = lambda x, y: F.bool_and((F.col(x) <= F.col(y) + tol) | (F.col("_dx") == 0))
    return f.groupBy(*by).agg(every("_fa", "_fb").alias("fsd_a_over_b"), every("_fb", "_fa").alias("fsd_b_over_a"), every("_ia", "_ib").alias("ssd_a_over_b"), every("_ib", "_ia").alias("ssd_b_over_a"))


def compare_distributions(df: DataFrame, a: Column, b: Column, value: str = "score") -> dict:
    """All of it for one pair, with p-values: the plans return one row each."""
    row = distances(df, a, b, value=value).crossJoin(effect_size(df, a, b, value=value)).crossJoin(dominance(df, a, b, value=value)).head()
    out = row.asDict()
    n, m = out["n_a"] or 0, out["n_b"] or 0
    out["ks_p"] = special.ks_pvalue(out["ks_d"] or 0.0, n, m)
    out["mwu_p"] = special.mannwhitney_pvalue(out["mwu_u"] or 0.0, n, m, out.pop("tie_term") or 0.0)
    return out


def length_bias(df: DataFrame, by: list[str] = (), score: str = "score", length: str = "length") -> DataFrame:
    """(keys, n, rho): Spearman correlation of score and length; null below 3 rows or where one is constant."""
    from episodeframe.operators.windows import average_ranks

    rows = known_keys(df, by).where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(length).isNotNull()).select(*by, F.col(score).alias("_s"), F.col(length).cast("double").alias("_l"))
    ranked = average_ranks(average_ranks(rows, "_s", by, "_rs"), "_l", by, "_rl")
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rs", "_rl").alias("_r"), F.stddev_pop("_rs").alias("_ds"), F.stddev_pop("_rl").alias("_dl"))
    return g.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("_ds") > 0) & (F.col("_dl") > 0), F.col("_r")).alias("rho"))


def length_bias_test(rho: float | None, n: int, threshold: float = 0.3) -> dict:
    """p-value by Student's t and whether the bias is significant and large."""
    if rho is None or math.isnan(rho):
        return {"rho": math.nan, "p": math.nan, "n": n, "flagged": False}
    p = 0.0 if abs(rho) >= 1 else 2 * special.t_sf(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    return {"rho": rho, "p": p, "n": n, "flagged": p < 0.05 and abs(rho) >= threshold}


def min_detectable_effect(n_a: int, n_b: int, power: float = 0.8, alpha: float = 0.05) -> float:
    if n_a < 1 or n_b < 1:
        return math.nan
    return (special.normal_ppf(1 - alpha / 2) + special.normal_ppf(power)) * math.sqrt(1 / n_a + 1 / n_b)


def power_table(df: DataFrame, control: str, by: str = "model", value: str = "score", power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Each group against ``control``: n, min_effect that its size can show, effect (pooled, absolute), and the n a side that the effect needs (null for none)."""
    z = special.normal_ppf(1 - alpha / 2) + special.normal_ppf(power)
    stats = known_keys(df, [by]).groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    base = stats.where(F.col(by) == control).select(F.col("n").alias("_cn"), F.col("_m").alias("_cm"), F.col("_v").alias("_cv"))
    both = stats.where(F.col(by) != control).crossJoin(F.broadcast(base))  # one row
    pooled = ((F.col("n") - 1) * F.col("_v") + (F.col("_cn") - 1) * F.col("_cv")) / (F.col("n") + F.col("_cn") - 2)
    effect = F.abs(F.col("_m") - F.col("_cm")) / F.sqrt(F.when(pooled > 0, pooled))
    out = both.withColumn("effect", effect)
    return out.select(by, "n", (z * F.sqrt(1 / F.col("n") + 1 / F.col("_cn"))).alias("min_effect"), "effect", F.ceil(2 * z * z / F.when(F.col("effect") > 0, F.col("effect") * F.col("effect"))).cast("bigint").alias("required_n"))


def required_n(effect: float, power: float = 0.8, alpha: float = 0.05, ratio: float = 1.0) -> int:
    if effect == 0 or not math.isfinite(effect):
        return 2**31 - 1
    z = special.normal_ppf(1 - alpha / 2) + special.normal_ppf(power)
    return math.ceil(z * z * (1 + 1 / ratio) / effect**2)


def analytical_ci(df: DataFrame, by: list[str] = (), ci: float = 0.95, value: str = "score") -> DataFrame:
    """(keys, point, lo, hi, width) of the mean; width 0 for a single value."""
    z = special.normal_ppf(1 - (1 - ci) / 2)
    g = known_keys(df, by).groupBy(*by).agg(F.avg(value).alias("point"), (F.lit(z) * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))).alias("_h"))
    return g.select(*by, "point", (F.col("point") - F.col("_h")).alias("lo"), (F.col("point") + F.col("_h")).alias("hi"), (2 * F.col("_h")).alias("width"))


def wilson_ci(df: DataFrame, by: list[str] = (), ci: float = 0.95) -> DataFrame:
    """(keys, k, n, point, lo, hi) of the success rate."""
    z = special.normal_ppf(1 - (1 - ci) / 2)
    g = known_keys(df, by).groupBy(*by).agg(F.sum(F.col("success").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))
    n, p = F.col("n"), F.col("k") / F.col("n")
    centre, margin = (p + z * z / (2 * n)) / (1 + z * z / n), F.lit(z) * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
    return g.select(*by, "k", "n", p.alias("point"), F.greatest(F.lit(0.0), centre - margin).alias("lo"), F.least(F.lit(1.0), centre + margin).alias("hi"))


def clopper_pearson_ci(df: DataFrame, by: list[str] = (), ci: float = 0.95) -> DataFrame:
    """Exact interval; the inverse beta function runs on the aggregated groups, in Arrow batches."""
    g = known_keys(df, by).groupBy(*by).agg(F.sum(F.col("success").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("lo double, hi double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([special.binomial_interval(int(a), int(b), ci) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"])

    return g.withColumn("_i", interval("k", "n")).select(*by, "k", "n", (F.col("k") / F.col("n")).alias("point"), "_i.lo", "_i.hi")


# ------------------------------------------------------------------ ranking
def win_counts(pairs: DataFrame, a: str = "a", b: str = "b", s: str = "s") -> DataFrame:
    """(i, j, wins) from results of ``a`` against ``b``: 1 won, 0 lost, 0.5 tied."""
    both = F.array(F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col(s).cast("double").alias("w")), F.struct(F.col(b).alias("i"), F.col(a).alias("j"), (1.0 - F.col(s)).alias("w")))
    return pairs.select(F.inline(both)).groupBy("i", "j").agg(F.sum("w").alias("wins"))
