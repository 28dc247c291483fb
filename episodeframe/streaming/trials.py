"""Trials as they run and end: calls in event order whatever the order of their arrival, with timers that close idle ones.

State of a trial, in Spark's state store: the calls that the watermark has not
passed yet, an entry for those of each batch, and one row of counters for those it has.  A timer stands for the
first waiting call; when the watermark passes it, the calls behind the watermark
are taken in (ts, order) and every one yields the features of its prefix, as
``trajectory.prefix_features`` does on a table.  Nothing later can come before
them: Spark drops calls behind the watermark (late ones).  A second timer stands
for the end: a trial without a call for longer than ``idle`` has ended, its last
features come out with ``ended`` and its state goes.  A call after that begins
the trial anew.  So the rows depend on the calls and the watermark alone, and not
on how micro-batches cut them.
"""

from __future__ import annotations

import contextlib
import itertools
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from episodeframe.operators.trajectory import EXECS, READS, WRITES

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_COUNTS = "began bigint, last bigint, n int, reads int, writes int, execs int, searches int, fw int, fe int, fr int, kinds string"
#: calls of one entry of the waiting ones
ENTRY = 4096
#: whole numbers of a call besides its order and tool; times are microseconds, free of the session's zone
FEATURES = ("micros", "began", "n", "reads", "writes", "execs", "searches", "fw", "fe", "kinds", "write_before_read", "ended")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The state store that these streams need, for queries started in the block; the session's own comes back after it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Counts:
    """Counters of a trial so far; times are microseconds."""

    def __init__(self, began: int, last: int, n: int = 0, reads: int = 0, writes: int = 0, execs: int = 0, searches: int = 0, fw: int = -1, fe: int = -1, fr: int = -1, kinds: str = "") -> None:
        self.began, self.last, self.n = began, last, n
        self.reads, self.writes, self.execs, self.searches = reads, writes, execs, searches
        self.fw, self.fe, self.fr = fw, fe, fr
        self.seen = set(kinds.split("\x1f")) if kinds else set()

    def take(self, at: int, tool: str | None) -> None:
        if tool in WRITES and self.fw < 0:
            self.fw = self.n
        if tool in EXECS and self.fe < 0:
            self.fe = self.n
        if tool in READS and self.fr < 0:
            self.fr = self.n
        self.reads += tool in READS
        self.writes += tool in WRITES
        self.execs += tool in EXECS
        self.searches += tool == "search_tool"
        if tool is not None:
            self.seen.add(tool)
        self.n += 1
        self.last = at

    def stored(self) -> tuple:
        return (self.began, self.last, self.n, self.reads, self.writes, self.execs, self.searches, self.fw, self.fe, self.fr, "\x1f".join(sorted(self.seen)))

    def features(self, ended: bool) -> tuple:
        n = self.n
        return (self.last, self.began, n, self.reads, self.writes, self.execs, self.searches, n if self.fw < 0 else self.fw, n if self.fe < 0 else self.fe, len(self.seen), int(0 <= self.fw < self.fr), int(ended))


class TrialProcessor(StatefulProcessor):
    """Rows are a trial's calls that a timer sets free, as lists; asking the store and making frames of each trial would cost more than the calls do."""

    def __init__(self, idle: int) -> None:
        """``idle`` in microseconds."""
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # An entry is the pickled list of a batch's (micros, order, tool).
        self.waiting = handle.getListState("waiting", "calls binary")
        self.counts = handle.getValueState("counts", _COUNTS)

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Entries of at most ``ENTRY`` calls, so that none of them grows with the batch.
        first = None
        while calls := [(r.micros, r.number, r.tool) for r in itertools.islice(rows, ENTRY)]:
            self.waiting.appendValue((pickle.dumps(calls),))
            least = min(c[0] for c in calls)
            first = least if first is None else min(first, least)
        if first is not None:
            self._timer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((c for (calls,) in self.waiting.get() for c in pickle.loads(calls)), key=lambda r: (r[0], r[1]))
        taken = [r for r in waiting if r[0] <= passed]
        rest = waiting[len(taken) :]
        if taken:
            if rest:
                self.waiting.put([(pickle.dumps(rest),)])
                self._timer(rest[0][0])
            else:
                self.waiting.clear()
        stored = self.counts.get()
        counts = None if stored is None else Counts(*stored)
        numbers: list = []
        tools: list = []
        features: list[int] = []

        def row(number, tool, ended: bool) -> None:
            numbers.append(number)
            tools.append(tool)
            features.extend(counts.features(ended))

        for at, number, tool in taken:
            if counts is not None and at - counts.last > self.idle:
                row(None, None, True)
                counts = None
            if counts is None:
                counts = Counts(at, at)
            counts.take(at, tool)
            row(number, tool, False)
        if counts is not None and counts.last + self.idle <= passed:
            row(None, None, True)
            counts = None
        if counts is None:
            if stored is not None:
                self.counts.clear()
        elif taken:
            self.counts.update(counts.stored())
            self._timer(counts.last + self.idle)
        if numbers:
            yield Row(trial=key[0], numbers=numbers, tools=tools, features=features)

    def close(self) -> None:
        pass


def stream_trials(calls: DataFrame, trial: str = "trial_id", ts: str = "ts", order: str = "event_id", tool: str = "tool", idle: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Features of every prefix in event order, and a row with ``ended`` (order and tool null) when a trial ends.

    ``began`` is the trial's first call.  Calls without a trial, a time or an
    order are left out; a null tool counts as a call of no kind.  Start the query
    within ``state_store``.
    """
    kinds = {c: calls.schema[c].dataType.simpleString() for c in (trial, order)}
    length = int(pd.Timedelta(idle) / pd.Timedelta(microseconds=1))
    rows = calls.select(F.col(trial).alias("trial"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("number"), F.col(tool).alias("tool"))
    rows = rows.where("trial is not null and ts is not null and number is not null").withWatermark("ts", watermark).withColumn("micros", F.unix_micros("ts"))
    out = f"trial {kinds[trial]}, numbers array<{kinds[order]}>, tools array<string>, features array<bigint>"
    freed = rows.groupBy("trial").transformWithState(TrialProcessor(length), out, "append", "eventTime")
    one = lambda number, i: F.struct(number.alias("number"), F.get("tools", i).alias("tool"), *(F.get("features", i * len(FEATURES) + k).alias(c) for k, c in enumerate(FEATURES)))
    found = freed.select("trial", F.inline(F.transform("numbers", one)))
    named = [F.col("trial").alias(trial), F.timestamp_micros("micros").alias(ts), F.col("number").alias(order), F.col("tool").alias(tool), F.timestamp_micros("began").alias("began")]
    whole = {"prefix_len": "n", "n_steps": "n", "n_reads": "reads", "n_writes": "writes", "n_exec": "execs", "n_search": "searches", "first_write_pos": "fw", "first_exec_pos": "fe"}
    ratios = [(F.col(c) / F.col("n")).alias(name) for c, name in (("searches", "search_ratio"), ("kinds", "tool_diversity"))]
    flags = [F.col(c).cast("boolean").alias(c) for c in ("write_before_read", "ended")]
    return found.select(*named, *(F.col(c).cast("int").alias(name) for name, c in whole.items()), *ratios, *flags)
