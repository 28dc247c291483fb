"""SQL functions for sessions that query episodes in SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType

from episodeframe.operators.trajectory import EXECS, READS, WRITES
from episodeframe.sources import checkpoints

#: plain SQL bodies: they are inlined into the plan
FUNCTIONS = {
    "pass_at_k": "(n BIGINT, c BIGINT, k INT) RETURNS DOUBLE RETURN CASE WHEN n < k THEN CAST(c > 0 AS INT) WHEN c < 0 OR c > n OR k < 0 THEN double('NaN') WHEN k = 0 THEN 0D ELSE 1 - aggregate(sequence(0, k - 1), 1D, (a, i) -> a * (n - c - i) / (n - i)) END",
    "pass_hat_k": "(n BIGINT, c BIGINT, k INT) RETURNS DOUBLE RETURN CASE WHEN n < k THEN CAST(c = n AS INT) WHEN c < 0 OR c > n OR k < 0 THEN double('NaN') WHEN k = 0 THEN 1D ELSE greatest(0D, aggregate(sequence(0, k - 1), 1D, (a, i) -> a * (c - i) / (n - i))) END",
    "outcome_kind": "(q_star DOUBLE, q_bar DOUBLE) RETURNS STRING RETURN CASE WHEN q_star = 0 THEN 'stuck' WHEN q_star - q_bar < 1e-9D THEN 'solid' ELSE 'recoverable' END",
    "consistency": "(q_star DOUBLE, q_bar DOUBLE) RETURNS DOUBLE RETURN CASE WHEN q_star = 0 THEN 0D WHEN q_star - q_bar < 1e-9D THEN 1D ELSE q_bar / q_star END",
    "hoeffding_radius": "(t BIGINT, ci DOUBLE) RETURNS DOUBLE RETURN sqrt(ln(2D / ((1 - ci) * 6D / (pi() * pi() * t * t))) / (2D * t))",
    "item_information": "(a DOUBLE, b DOUBLE, theta DOUBLE) RETURNS DOUBLE RETURN a * a * (1 / (1 + exp(-a * (theta - b)))) * (1 - 1 / (1 + exp(-a * (theta - b))))",
    "task_words": "(text STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(lower(text), '[a-z0-9]+', 0))",
}



# ------------------------------------------------------------------ aggregates
# Over the distribution table (keys, score, count): a group is as long as it has
# different scores, because Python aggregates hold a group in one task.
def _sorted(score: pd.Series, n: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    known = score.notna() & n.notna()
    order = np.argsort(score[known].to_numpy(), kind="stable")
    return score[known].to_numpy()[order], n[known].to_numpy()[order].astype(np.int64)


def _quantile(x: np.ndarray, n: np.ndarray, p: float) -> float:
    upto, place = np.cumsum(n), p * (n.sum() - 1)
    low, high = (x[np.searchsorted(upto, math.floor(place), side="right")], x[np.searchsorted(upto, math.ceil(place), side="right")])
    return float(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)


def _mean(x: np.ndarray, n: np.ndarray, inside: np.ndarray) -> float | None:
    return float((x[inside] * n[inside]).sum() / n[inside].sum()) if inside.any() else None


@pandas_udf(DoubleType())
def iqm(score: pd.Series, n: pd.Series) -> float:
    x, n = _sorted(score, n)
    return _mean(x, n, (x >= _quantile(x, n, 0.25)) & (x <= _quantile(x, n, 0.75))) if len(x) else None


@pandas_udf(DoubleType())
def cvar(score: pd.Series, n: pd.Series, alpha: pd.Series) -> float:
    x, n = _sorted(score, n)
    return _mean(x, n, x <= _quantile(x, n, float(alpha.iloc[0]))) if len(x) else None


@pandas_udf(DoubleType())
def outcome_entropy(score: pd.Series, n: pd.Series) -> float:
    x, n = _sorted(score, n)
    if n.sum() < 2 or x[0] == x[-1]:
        return 0.0
    edges = x[0] + np.arange(1, 5) * ((x[-1] - x[0]) / 5)
    share = np.bincount(np.searchsorted(edges, x, side="right"), weights=n, minlength=5) / n.sum()
    return float(-(share[share > 0] * np.log(share[share > 0])).sum())


AGGREGATES = {"iqm": iqm, "cvar": cvar, "outcome_entropy": outcome_entropy}


# ------------------------------------------------------------- table functions
class ToolPrefixes:
    """``tool_prefixes(TABLE(calls) PARTITION BY trial_id ORDER BY ...)``: features of every prefix of a trial.

    ``calls`` has (trial_id, event_id, tool); state is a few counters.
    """

    def __init__(self) -> None:
        self.n, self.counts, self.first, self.seen = 0, [0, 0, 0, 0], [-1, -1, -1], set()

    def eval(self, row: Row):
        tool = row["tool"]
        for i, kind in enumerate((READS, WRITES, EXECS)):
            if tool in kind:
                self.counts[i] += 1
                self.first[i] = self.n if self.first[i] < 0 else self.first[i]
        self.counts[3] += tool == "search_tool"
        self.seen.add(tool)
        self.n += 1
        read, write, execute = (f if f >= 0 else self.n for f in self.first)
        yield str(row["trial_id"]), row["event_id"], self.n, *self.counts, write, execute, self.counts[3] / self.n, len(self.seen) / self.n, self.first[1] >= 0 and self.first[0] > self.first[1]


class ScriptCheckpoints:
    """``script_checkpoints(task, text)``, by LATERAL: the checkpoints of a test script; an empty one has none."""

    def eval(self, task: str, text: str):
        if task is not None and text and not text.isspace():
            yield from checkpoints.parse(text, task)


TABLE_FUNCTIONS = {
    "tool_prefixes": (ToolPrefixes, "trial_id string, event_id bigint, prefix_len int, n_reads bigint, n_writes bigint, n_exec bigint, n_search bigint, first_write_pos int, first_exec_pos int, search_ratio double, tool_diversity double, write_before_read boolean"),
    "script_checkpoints": (ScriptCheckpoints, checkpoints.SCHEMA),
}


def register(spark: SparkSession) -> list[str]:
    """Scalar functions, aggregates and table functions for SQL; their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    for name, function in AGGREGATES.items():
        spark.udf.register(name, function)
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
    return [*FUNCTIONS, *AGGREGATES, *TABLE_FUNCTIONS]
