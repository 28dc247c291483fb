"""Resampling and models: bootstrap, prediction-powered means, item response, ranking."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.functions import special
from episodeframe.functions.columns import known_keys


# ---------------------------------------------------------------- bootstrap
def bootstrap_draws(df: DataFrame, strata: list[str], reps: int, seed: int = 0, value: str = "score") -> DataFrame:
    """(strata, rep, score, n): how often each different score is drawn in each replicate.

    Within a stratum an n-of-n draw is multinomial over its different scores, so
    one row per (stratum, score) is resampled, not the episodes: conditional
    binomials, seeded by (seed, replicate block, stratum), the same whatever
    the partitioning.
    """
    keys = list(strata)
    dist = known_keys(df, keys).groupBy(*keys, F.col(value).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    name = F.xxhash64(F.lit(seed), *(F.col(k).cast("string") for k in keys))
    groups = dist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("score", "n"))).alias("d")).withColumn("_seed", name)
    block = 500
    blocks = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // block))).alias("_block"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = np.array([x["score"] for x in row["d"]])
                n = np.array([x["n"] for x in row["d"]])
                rng = np.random.default_rng([row["_seed"] & 0xFFFFFFFF, row["_block"]])
                first = row["_block"] * block
                size = min(block, reps - first)
                drawn = rng.multinomial(n.sum(), n / n.sum(), size=size)
                rep, which = np.nonzero(drawn)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[k]] * len(rep)) for k in keys), pa.array(first + rep, pa.int32()), pa.array(values[which], pa.float64()), pa.array(drawn[rep, which], pa.int64())],
                    names=[*keys, "rep", "score", "n"],
                )

    spread = blocks.repartition(*(F.col(k) for k in keys), "_block") if keys else blocks.repartition("_block")
    return spread.mapInArrow(run, (kinds + ", " if kinds else "") + "rep int, score double, n bigint")


STATISTICS = {
    "mean": lambda: F.sum(F.col("score") * F.col("n")) / F.sum("n"),
    "median": lambda: F.percentile("score", F.lit(0.5), F.col("n")),
    "min": lambda: F.min("score"),
}


def bootstrap_ci(df: DataFrame, stat: str = "mean", strata: list[str] = (), reps: int = 5000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: point, lo, hi, width, n_reps of a statistic under stratified resampling."""
    draws = bootstrap_draws(df, list(strata), reps, seed)
    boot = draws.groupBy("rep").agg(STATISTICS[stat]().alias("b"))
    tail = (1 - ci) / 2
    ends = boot.agg(F.percentile("b", F.lit(tail)).alias("lo"), F.percentile("b", F.lit(1 - tail)).alias("hi"), F.count(F.lit(1)).alias("n_reps"))
    point = df.groupBy("score").agg(F.count(F.lit(1)).alias("n")).agg(STATISTICS[stat]().alias("point"))
    return point.crossJoin(ends).select("point", "lo", "hi", (F.col("hi") - F.col("lo")).alias("width"), "n_reps")


def bootstrap_function_ci(df: DataFrame, stat_fn: Callable, strata: list[str] = (), reps: int = 1000, ci: float = 0.95, seed: int = 0) -> dict:
    """An arbitrary Python statistic of a pandas frame: the frame is broadcast, so it must be bounded, and replicates run in parallel."""
    frame = df.limit(1_000_001).toPandas()
    if len(frame) > 1_000_000:
        raise ValueError("more than 1,000,000 rows: use a named statistic of bootstrap_ci")
    keys = list(strata)
    groups = [g.index.to_numpy() for _, g in frame.groupby(keys)] if keys else [frame.index.to_numpy()]

    def run(batches):
        for batch in batches:
            out = []
            for rep in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, rep])
                out.append(float(stat_fn(frame.loc[np.concatenate([rng.choice(g, len(g)) for g in groups])])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["b"])

    tail = (1 - ci) / 2
    lo, hi = df.sparkSession.range(reps).mapInArrow(run, "b double").agg(F.percentile("b", F.lit(tail)), F.percentile("b", F.lit(1 - tail))).head()
    return {"point": float(stat_fn(frame)), "lo": lo, "hi": hi, "width": hi - lo, "ci": ci, "n_reps": reps}


def bootstrap_vs_repeat(df: DataFrame, stat: str = "mean", run: str = "run_id", strata: list[str] = (), reps: int = 1000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean width of single-run bootstrap intervals against the spread over real runs: one row."""
    draws = bootstrap_draws(df, [run, *strata], reps, seed)
    tail = (1 - ci) / 2
    width = draws.groupBy(run, "rep").agg(STATISTICS[stat]().alias("b")).groupBy(run).agg((F.percentile("b", F.lit(1 - tail)) - F.percentile("b", F.lit(tail))).alias("w")).agg(F.avg("w").alias("bootstrap_width"))
    real = df.groupBy(run, "score").agg(F.count(F.lit(1)).alias("n")).groupBy(run).agg(STATISTICS[stat]().alias("s")).agg((F.percentile("s", F.lit(1 - tail)) - F.percentile("s", F.lit(tail))).alias("repeat_width"))
    return width.crossJoin(real).withColumn("underconfidence", F.col("repeat_width") / F.when(F.col("bootstrap_width") > 0, F.col("bootstrap_width")))


# ------------------------------------------------- prediction-powered means
def ppi_moments(df: DataFrame, gold: str = "gold", judge: str = "judge") -> DataFrame:
    """One row of moments: labelled rows have both values, the others the judge's only."""
    has = F.col(gold).isNotNull() & F.col(judge).isNotNull()
    y, f, u = F.when(has, F.col(gold).cast("double")), F.when(has, F.col(judge).cast("double")), F.when(F.col(gold).isNull(), F.col(judge).cast("double"))
    return df.agg(
        F.count(y).alias("n"), F.count(u).alias("big_n"), F.avg(y).alias("mean_gold"), F.avg(f).alias("mean_judge"), F.avg(u).alias("mean_unlabelled"),
        F.var_samp(y).alias("var_gold"), F.var_samp(f).alias("var_judge"), F.var_samp(u).alias("var_unlabelled"), F.covar_samp(y, f).alias("cov"),
    )


def ppi_mean(df: DataFrame, gold: str = "gold", judge: str = "judge", lam: float | None = None, ci: float = 0.95) -> DataFrame:
    """point, lam, lo, hi, se: lam = cov / (var_judge + n/N var_unlabelled), clipped to [0, 1], unless given; 0 without unlabelled rows or with one label."""
    m = ppi_moments(df, gold, judge)
    n, big = F.col("n"), F.col("big_n")
    spread = F.col("var_judge") + n / big * F.coalesce("var_unlabelled", F.lit(0.0))
    best = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cov") / F.when(spread > 0, spread))), F.lit(0.0))
    m = m.withColumn("lam", F.when((n < 2) | (big < 1), F.lit(0.0)).otherwise(best if lam is None else F.lit(float(lam))))
    point = F.col("mean_gold") + F.when(F.col("lam") != 0, F.col("lam") * (F.col("mean_unlabelled") - F.col("mean_judge"))).otherwise(0.0)
    residual = F.col("var_gold") + F.pow("lam", F.lit(2)) * F.col("var_judge") - 2 * F.col("lam") * F.col("cov")
    se = F.sqrt(F.greatest(F.lit(0.0), residual / n + F.pow("lam", F.lit(2)) * F.coalesce("var_unlabelled", F.lit(0.0)) / F.greatest(big, F.lit(1))))
    z = special.normal_ppf(1 - (1 - ci) / 2)
    return m.select("n", "big_n", "lam", point.alias("point"), se.alias("se"), (point - z * se).alias("lo"), (point + z * se).alias("hi"))


# ------------------------------------------------------------ item response
def responses(df: DataFrame, by: str = "model") -> DataFrame:
    """(model, task, x): 1 where the mean success is at least one half; unattempted cells are absent."""
    return known_keys(df, [by, "task"]).groupBy(by, "task").agg((F.avg(F.col("success").cast("double")) >= 0.5).cast("int").alias("x"))


def fit_2pl(cells: DataFrame, by: str = "model", model: str = "2pl", prior_sd: float = 1.0, max_iter: int = 200, most_cells: int = 4_000_000):
    """Penalised joint maximum likelihood of abilities and items: (abilities, items) as pandas frames.

    The aggregated response table has one row a cell; a bound on them is checked
    before they are fetched.
    """
    import pandas as pd

    n = cells.count()
    if n > most_cells:
        raise ValueError(f"{n} cells exceed most_cells={most_cells}")
    data = cells.select(by, "task", "x").toPandas()
    people, tasks = sorted(data[by].unique()), sorted(data["task"].unique())
    r = data[by].map({p: i for i, p in enumerate(people)}).to_numpy()
    i = data["task"].map({t: k for k, t in enumerate(tasks)}).to_numpy()
    x = data["x"].to_numpy(float)
    R, I, weight = len(people), len(tasks), 1.0 / prior_sd**2
    free = model == "2pl"

    def loss(v):
        theta, b, la = v[:R], v[R : R + I], v[R + I :] if free else np.zeros(I)
        a = np.exp(la)
        z = a[i] * (theta[r] - b[i])
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        value = np.sum(np.logaddexp(0, z) - x * z) + 0.5 * weight * (theta @ theta + b @ b + la @ la)
        d = p - x
        g = [np.bincount(r, d * a[i], R) + weight * theta, -np.bincount(i, d * a[i], I) + weight * b]
        if free:
            g.append(np.bincount(i, d * z, I) + weight * la)
        return value, np.concatenate(g)

    v = lbfgs(loss, np.zeros(R + I * (2 if free else 1)), max_iter)
    theta, b, a = v[:R], v[R : R + I], np.exp(v[R + I :]) if free else np.ones(I)
    mean, sd = theta.mean(), theta.std() or 1.0
    return (pd.DataFrame({by: people, "ability": (theta - mean) / sd}), pd.DataFrame({"task": tasks, "a": a * sd, "b": (b - mean) / sd}))


def lbfgs(loss, v: np.ndarray, max_iter: int, memory: int = 10, tol: float = 1e-6) -> np.ndarray:
    """Minimise with limited memory and a backtracking (Armijo) line search."""
    value, grad = loss(v)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(past, reversed(alphas), strict=True):
            q += s * (alpha - rho * (y @ q))
        slope = -(grad @ q)
        if slope >= 0:
            q, slope, past = grad.copy(), -(grad @ grad), []
        step = 1.0
        while True:
            fresh = v - step * q
            new_value, new_grad = loss(fresh)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = fresh - v, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1.0 / (s @ y))]
        done = abs(value - new_value) <= tol * 1e-3 * max(1.0, abs(value)) or np.max(np.abs(new_grad)) < tol
        v, value, grad = fresh, new_value, new_grad
        if done:
            break
    return v


def total_information(items: DataFrame, thetas: list[float]) -> DataFrame:
    """(theta, information) summed over items (a, b)."""
    from episodeframe.functions.columns import item_information

    grid = items.select("a", "b", F.explode(F.array(*(F.lit(float(t)) for t in thetas))).alias("theta"))
    return grid.groupBy("theta").agg(F.sum(item_information(F.col("a"), F.col("b"), F.col("theta"))).alias("information"))


def select_items(items: DataFrame, n: int, thetas: list[float]) -> DataFrame:
    """The ``n`` items with most information over the grid; ties by task."""
    from episodeframe.functions.columns import item_information

    total = F.aggregate(F.array(*(F.lit(float(t)) for t in thetas)), F.lit(0.0), lambda acc, t: acc + item_information(F.col("a"), F.col("b"), t))
    return items.withColumn("information", total).orderBy(F.desc("information"), "task").limit(n)


# ------------------------------------------------------------------ ranking
def _fit_strengths(wins: np.ndarray, games: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    k = len(wins)
    p = np.full(k, 1.0)
    for it in range(1, max_iter + 1):
        old = p.copy()
        for i in range(k):
            others = np.arange(k) != i
            rate = np.sum(games[i, others] / (p[i] + p[others]))
            if rate > 0:
                p[i] = wins[i] / rate
        p /= p.sum()
        if np.abs(p - old).max() < tol:
            break
    return p, it


def bradley_terry(wins: DataFrame, ci: float | None = None, reg: float = 1e-3, n_boot: int = 1000, seed: int = 0, max_iter: int = 1000, tol: float = 1e-9, most: int = 2000) -> dict:
    """Strengths (log, centred) of the systems of a (i, j, wins) table; its K x K cells are the bound of what is fetched."""
    rows = wins.limit(most * most + 1).toPandas()
    items = sorted(set(rows["i"]) | set(rows["j"]))
    k = len(items)
    if k < 2:
        raise ValueError("need at least 2 systems to rank")
    if k > most:
        raise ValueError(f"more than {most} systems")
    at = {name: n for n, name in enumerate(items)}
    w = np.zeros((k, k))
    w[rows["i"].map(at), rows["j"].map(at)] = rows["wins"]
    np.fill_diagonal(w, 0)
    prior = reg * (1 - np.eye(k))
    games = w + w.T + 2 * prior
    p, iterations = _fit_strengths((w + prior).sum(1), games, max_iter, tol)
    centred = lambda q: np.log(q) - np.log(q).mean()
    strength = centred(p)
    ranking = np.argsort(-strength, kind="stable")
    out = {"items": items, "strengths": strength, "probs": p, "ranking": [items[i] for i in ranking], "iterations": iterations}
    if ci is not None:
        chance = p[:, None] / (p[:, None] + p[None, :])
        played = np.rint(games).astype(int)
        upper = np.triu_indices(k, 1)

        def run(batches):
            for batch in batches:
                found = []
                for rep in batch.column(0).to_pylist():
                    rng = np.random.default_rng([seed, rep])
                    won = rng.binomial(played[upper], chance[upper])
                    b = prior.copy()
                    b[upper] += won
                    b.T[upper] += played[upper] - won
                    found.append(centred(_fit_strengths(b.sum(1), b + b.T, max_iter, tol)[0]).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], names=["s"])

        boot = np.array([r[0] for r in wins.sparkSession.range(n_boot).mapInArrow(run, "s array<double>").collect()])
        lo, hi = np.quantile(boot, [(1 - ci) / 2, (1 + ci) / 2], axis=0)
        top, second = ranking[0], ranking[1]
        out |= {"strength_lo": lo, "strength_hi": hi, "ranking_unstable": bool((hi[ranking[1:]] >= lo[top]).any()), "rank_flip_prob": float((boot[:, second] >= boot[:, top]).mean())}
    return out
