"""Plot-ready tables, text reports and their JSON: small results only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.operators import failure, metrics, taxonomy


def leaderboard(eps: DataFrame, alpha: float = 0.1) -> DataFrame:
    s = metrics.summarize(eps, ["model"], alpha, (1, 3))
    return s.withColumn("reliability", 2 * F.col("cvar_a") + F.col("pass_hat_3") + F.col("iqm")).orderBy(F.desc("reliability"), "model")


def plot_tables(eps: DataFrame) -> dict[str, DataFrame]:
    """What the charts show, one table each."""
    return {
        "performance_profile": metrics.performance_profile(eps, by=["model"]),
        "ecdf": metrics.ecdf(eps, ["model"]),
        "mean_vs_cvar": metrics.summarize(eps, ["model"], ks=(1,)).select("model", "mean", "cvar_a"),
        "pass_gap": metrics.pass_curve(eps, by=["model"]),
        "reliability": metrics.reliability_decay(eps, by=["model"]),
        "leaderboard": leaderboard(eps),
        "failures": failure.failure_distribution(eps, ["model"]),
    }


def save_plots(eps: DataFrame, folder: str) -> list[str]:
    """PNG files where matplotlib can be imported; none otherwise."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt
    except ImportError:
        return []
    out = []
    for name, x, y in (("performance_profile", "tau", "fraction"), ("ecdf", "score", "cdf"), ("pass_gap", "k", "pass_hat_k")):
        fig, ax = plt.subplots()
        for model, part in plot_tables(eps)[name].orderBy(x).toPandas().groupby("model"):
            ax.plot(part[x], part[y], label=model)
        ax.set_xlabel(x)
        ax.set_ylabel(y)
        ax.legend()
        out.append(f"{folder}/{name}.png")
        fig.savefig(out[-1])
        plt.close(fig)
    return out


def compare_models(eps: DataFrame, a: str, b: str) -> dict:
    """Every comparison of two models, with the metrics each wins."""
    from episodeframe.operators.compare import compare_distributions

    result = compare_distributions(eps, F.col("model") == a, F.col("model") == b)
    rows = {r["model"]: r for r in leaderboard(eps.where(F.col("model").isin(a, b))).collect()}
    wins = {m: a if rows[a][m] > rows[b][m] else b if rows[a][m] < rows[b][m] else None for m in ("mean", "iqm", "cvar_a", "pass_at_1", "pass_hat_3", "reliability")}
    return {**result, "wins": wins, "n_won_a": sum(w == a for w in wins.values()), "n_won_b": sum(w == b for w in wins.values())}


def summary(eps: DataFrame) -> dict:
    """summary.json: overall and by stratum, failures, outcome taxonomy, rank inversions."""
    strata = [c for c in eps.columns if c.startswith("s_")]
    board = leaderboard(eps).collect()
    by_mean = sorted(board, key=lambda r: -r["mean"])
    profiles = taxonomy.task_profiles(eps)
    return {
        "overall": metrics.summarize(eps).head().asDict(),
        "strata": [r.asDict() for r in metrics.grouping_summary(eps, strata).collect()],
        "leaderboard": [r.asDict() for r in board],
        "inversion": [r["model"] for r in board] != [r["model"] for r in by_mean],
        "failures": [r.asDict() for r in failure.failure_distribution(eps).collect()],
        "right_tail": [r.asDict() for r in taxonomy.compare_agents(profiles).collect()],
    }


def save_summary(eps: DataFrame, path: str) -> dict:
    out = summary(eps)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, default=str)
    return out


def text_report(eps: DataFrame) -> str:
    """The leaderboard as aligned text."""
    cols = ("model", "n_episodes", "mean", "iqm", "cvar_a", "pass_at_1", "pass_hat_3")
    lines = ["  ".join(f"{c:>12}" for c in cols)]
    for r in leaderboard(eps).collect():
        lines.append("  ".join(f"{r[c]:>12.3f}" if isinstance(r[c], float) else f"{r[c]!s:>12}" for c in cols))
    return "\n".join(lines)
