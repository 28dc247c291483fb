"""Operators on ordered rows; running values come from scans over ranges, so no key is sorted in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.operators.scans import Running, beside, running


def grpo_advantages(df: DataFrame, groups: list[str] = ("task",), value: str = "score", eps: float = 1e-8) -> DataFrame:
    """(score - group mean) / (group population std + eps) beside every row.

    Group statistics are aggregated first and joined back, so a group of any
    size is never sorted or held in one task.
    """
    keys = list(groups)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    both = df.join(stats, keys) if keys else df.crossJoin(stats)
    return both.withColumn("advantage", (F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(eps))).drop("_m", "_s")


def confidence_sequence(df: DataFrame, order: list[str], by: list[str] = (), value: str = "score", ci: float = 0.95, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Anytime-valid Hoeffding bounds of the running mean after each row: t, running_mean, running_lo, running_hi."""
    if hi <= lo:
        raise ValueError("hi must be greater than lo")
    out = running(df, list(order), list(by), {"t": Running("count"), "_n": Running("count", F.col(value)), "_s": Running("sum", F.col(value).cast("double"))})
    out = out.withColumn("running_mean", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_n", "_s")
    alpha_t = F.lit((1 - ci) * 6.0 / math.pi**2) / (F.col("t") * F.col("t"))
    radius = F.lit(hi - lo) * F.sqrt(F.log(2.0 / alpha_t) / (2.0 * F.col("t")))
    bound = lambda x: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    return out.withColumn("running_lo", bound(F.col("running_mean") - radius)).withColumn("running_hi", bound(F.col("running_mean") + radius))


def adjust_pvalues(df: DataFrame, p: str = "p", method: str = "bh", by: list[str] = (), tiebreak: list[str] = ()) -> DataFrame:
    """Adds ``p_adjusted``: Benjamini-Hochberg (bh, fdr) or Holm.

    Equal p-values have equal results, so the scan runs over different values
    with their counts, and ``tiebreak`` makes no difference.  A null is adjusted
    to null and not counted.
    """
    keys = list(by)
    kind = method.lower()
    if kind not in ("bh", "fdr", "benjamini-hochberg", "holm"):
        raise ValueError(f"unknown method {method!r}")
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    whole = beside(running(counts, ["_p"], keys, {"_upto": Running("sum", F.col("_n"))}), total, keys)
    if kind == "holm":
        # The first of equal ones has the largest factor.
        raw, fold = (F.col("_all") - F.col("_upto") + F.col("_n")) * F.col("_p"), "max"
    else:
        raw, fold = F.col("_all") / F.col("_upto") * F.col("_p"), "min"
    found = running(whole.withColumn("_raw", raw), ["_p"], keys, {"_adjusted": Running(fold, F.col("_raw"), reverse=fold == "min")})
    bound = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_adjusted")))
    named = found.select(*(F.col(k).alias(f"_g_{k}") for k in keys), "_p", bound.alias("p_adjusted"))
    meet = [F.col(p) == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys)]
    return df.join(named, meet, "left").select(*(F.col(f"`{c}`") for c in df.columns), "p_adjusted")


def average_ranks(df: DataFrame, value: str, by: list[str] = (), out: str = "avg_rank") -> DataFrame:
    """Ranks from 1, ties share the mean of theirs; from counts of different values."""
    keys = list(by)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, [value], keys, {"_upto": Running("sum", F.col("_n"))})
    return df.join(ranks.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), [*keys, value])


def kappa_changes(cycles: DataFrame, by: list[str] = (), plateau: float = 0.01) -> DataFrame:
    """Adds ``delta`` and ``plateaued`` (|delta| below ``plateau``) to a log of (cycle, kappa)."""
    before = running(cycles, ["cycle"], list(by), {"_before": Running("last", F.col("kappa"), exclusive=True)})
    return before.withColumn("delta", F.col("kappa") - F.col("_before")).drop("_before").withColumn("plateaued", F.coalesce(F.abs("delta") < plateau, F.lit(False)))
