"""Growing trajectories and scores as streams.

State is one small row a trial (counters and first positions), kept in Spark's
state store; a trial that is idle for ``timeout`` of event time is closed and
its state dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from episodeframe.operators.trajectory import EXECS, READS, WRITES, Predictor, check

_FEATURES = "prefix_len int, n_steps int, n_reads int, n_writes int, n_exec int, n_search int, first_write_pos int, first_exec_pos int, search_ratio double, tool_diversity double, write_before_read boolean"
_STATE = "n int, reads int, writes int, execs int, searches int, fw int, fe int, fr int, kinds string"


def stream_prefixes(calls: DataFrame, trial: str = "trial_id", ts: str = "ts", order: str = "event_id", tool: str = "tool", watermark: str = "10 minutes") -> DataFrame:
    """Features of every prefix as calls arrive: the streaming form of ``prefix_features``.

    Calls of one trial are taken in (ts, order) within a micro-batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, reads, writes, execs, searches, fw, fe, fr, kinds = state.get if state.exists else (0, 0, 0, 0, 0, -1, -1, -1, "")
        seen = set(kinds.split("\x1f")) if kinds else set()
        rows = []
        batch = pd.concat(list(frames)).sort_values([ts, order])
        for at, number, name in zip(batch[ts], batch[order], batch[tool], strict=True):
            if name in WRITES and fw < 0:
                fw = n
            if name in EXECS and fe < 0:
                fe = n
            if name in READS and fr < 0:
                fr = n
            reads, writes, execs, searches = reads + (name in READS), writes + (name in WRITES), execs + (name in EXECS), searches + (name == "search_tool")
            seen.add(name)
            n += 1
            rows.append((key[0], at, number, name, n, n, reads, writes, execs, searches, fw if fw >= 0 else n, fe if fe >= 0 else n, searches / n, len(seen) / n, 0 <= fw < fr))
        state.update((n, reads, writes, execs, searches, fw, fe, fr, "\x1f".join(sorted(seen))))
        limit = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(limit, int(batch[ts].max().timestamp() * 1000)) + 600_000)
        yield pd.DataFrame(rows, columns=[trial, ts, order, tool, *(c.split()[0] for c in _FEATURES.split(", "))])

    kinds = {c: calls.schema[c].dataType.simpleString() for c in (trial, order, tool)}
    out = f"{trial} {kinds[trial]}, {ts} timestamp, {order} {kinds[order]}, {tool} string, {_FEATURES}"
    src = calls.select(trial, F.col(ts).cast("timestamp").alias(ts), order, tool).withWatermark(ts, watermark)
    return src.groupBy(trial).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_checks(calls: DataFrame, predictor: Predictor, **options) -> DataFrame:
    """Prediction, confidence and warning after every call."""
    return check(stream_prefixes(calls, **options), predictor)


def stream_confidence(scores: DataFrame, by: str = "task", ts: str = "ts", value: str = "score", ci: float = 0.95, watermark: str = "1 hour") -> DataFrame:
    """Anytime-valid bounds of the running mean of each key, after each micro-batch that touches it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        alpha = (1 - ci) * 6 / (math.pi**2 * n * n)
        radius = math.sqrt(math.log(2 / alpha) / (2 * n))
        mean = total / n
        yield pd.DataFrame({by: [key[0]], "t": [n], "running_mean": [mean], "running_lo": [max(0.0, mean - radius)], "running_hi": [min(1.0, mean + radius)]})

    src = scores.select(by, F.col(ts).cast("timestamp").alias(ts), value).withWatermark(ts, watermark)
    return src.groupBy(by).applyInPandasWithState(step, f"{by} {scores.schema[by].dataType.simpleString()}, t bigint, running_mean double, running_lo double, running_hi double", "n bigint, total double", "append", GroupStateTimeout.NoTimeout)


def stream_kappa(episodes: DataFrame, ts: str = "ts", window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Mean score and success rate of each model and window, emitted once the watermark passes it."""
    src = episodes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return src.groupBy(F.window(ts, window), "model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def stream_memories(records: DataFrame, path: str, checkpoint: str):
    """Append arriving trajectory records to a memory table; the query to start or stop."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
