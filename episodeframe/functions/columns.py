"""Column expressions the operators are made of; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_keys(df, by: list[str]):
    """Rows whose group keys are all present: a null key is no group."""
    for name in by:
        df = df.where(F.col(name).isNotNull())
    return df


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def _product(k: Column, factor) -> Column:
    # sequence(0, k-1) would count down for k = 0.
    steps = F.when(k > 0, F.sequence(F.lit(0), k.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * factor(i))


def pass_at(n: Column, c: Column, k: Column) -> Column:
    """P(some of k trials succeeds) from c successes in n; c > 0 if n < k; NaN for impossible counts."""
    missing = _product(k, lambda i: (n - c - i) / (n - i))
    return F.when(n < k, (c > 0).cast("double")).when((c < 0) | (c > n) | (k < 0), F.lit(float("nan"))).otherwise(1 - missing)


def pass_hat(n: Column, c: Column, k: Column) -> Column:
    """P(all of k trials succeed)."""
    every = _product(k, lambda i: (c - i) / (n - i))
    return F.when(n < k, (c == n).cast("double")).when((c < 0) | (c > n) | (k < 0), F.lit(float("nan"))).otherwise(F.greatest(every, F.lit(0.0)))


def entropy(scores: Column, n_bins: int = 5) -> Column:
    """Shannon entropy (nats) of an array's histogram between its own extremes."""
    lo, hi, n = F.array_min(scores), F.array_max(scores), F.size(scores)
    edge = lambda i: lo + i * ((hi - lo) / n_bins)
    inside = lambda i: lambda s: (s >= edge(i)) & ((s <= hi) if i == n_bins - 1 else (s < edge(i + 1)))
    total = F.lit(0.0)
    for i in range(n_bins):
        p = F.size(F.filter(scores, inside(i))) / n
        total = total - F.when(p > 0, p * F.log(p)).otherwise(0.0)
    return F.when((n < 2) | (lo == hi), F.lit(0.0)).otherwise(total)


def item_information(a: Column, b: Column, theta: Column) -> Column:
    p = 1 / (1 + F.exp(-a * (theta - b)))
    return a * a * p * (1 - p)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -30.0, 30.0)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
