"""The monitor with timers: event order, ends of idle trials, late calls, restarts."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import Row

from episodeframe.operators import trajectory
from episodeframe.streaming import trials

CALLS = "trial_id string, ts timestamp, event_id bigint, tool string"
START = datetime(2024, 1, 1)
NAMES = ["n_reads", "n_writes", "n_exec", "n_search", "first_write_pos", "first_exec_pos", "search_ratio", "tool_diversity", "write_before_read"]


def played(spark, tmp_path, batches, **options):
    """Every batch is a file of its own, read in a run of the query of its own: state outlives restarts."""
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    spark.createDataFrame([], CALLS).write.parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(source)
        with trials.state_store(spark):
            stream = trials.stream_trials(spark.readStream.schema(CALLS).parquet(source), **options)
            stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_any_arrival_order_gives_the_rows_of_the_table(spark, tmp_path):
    r = random.Random(5)
    tools = ["read_file", "write_file", "run_shell_command", "search_tool", "list_directory"]
    calls = [(f"t{r.randrange(3)}", at(i // 2), i, r.choice(tools)) for i in range(60)]
    mixed = sorted(calls, key=lambda c: c[1].timestamp() / 60 + r.uniform(0, 8))
    last = [("clock", at(500), 1000, "read_file")]
    found = played(spark, tmp_path, [mixed[:25], mixed[25:50], mixed[50:], last], watermark="10 minutes", idle="60 minutes")
    wanted = trajectory.prefix_features(spark.createDataFrame(calls, CALLS), "trial_id", ["ts", "event_id"])
    key = lambda df: sorted(map(tuple, df.select("trial_id", "event_id", "prefix_len", *NAMES).collect()))
    assert key(found.where("not ended")) == key(wanted)
    ends = found.where("ended").collect()
    assert sorted(e["trial_id"] for e in ends) == ["t0", "t1", "t2"]
    assert all(e["event_id"] is None and e["tool"] is None and e["prefix_len"] == sum(c[0] == e["trial_id"] for c in calls) for e in ends)


def test_ends_new_beginnings_late_and_null_calls(spark, tmp_path):
    batches = [
        [("a", at(0), 1, "read_file"), ("a", at(30), 2, None), ("a", at(61), 3, "write_file"), (None, at(1), 4, "read_file"), ("b", None, 5, "read_file")],
        [("z", at(80), 6, "read_file")],
        [("a", at(5), 7, "read_file"), ("a", at(75), 8, "search_tool")],  # the first is late
        [("z", at(200), 9, "read_file")],
    ]
    found = played(spark, tmp_path, batches, watermark="0 minutes", idle="30 minutes")
    a = [tuple(r) for r in found.where("trial_id = 'a'").orderBy("ts", "ended").select("event_id", "began", "prefix_len", "ended").collect()]
    # Exactly 30 minutes go on, 31 begin anew; event 8 came after the watermark had passed it.
    assert a == [(1, at(0), 1, False), (2, at(0), 2, False), (None, at(0), 2, True), (3, at(61), 1, False), (None, at(61), 1, True)]
    assert found.where("trial_id is null or trial_id = 'b'").count() == 0
    z = [tuple(r) for r in found.where("trial_id = 'z'").orderBy("ts", "ended").select("event_id", "ended").collect()]
    assert z == [(6, False), (None, True), (9, False)]
    two = found.where("event_id = 2").head()
    assert (two["n_reads"], two["tool_diversity"]) == (1, 0.5)


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with trials.state_store(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


class Stored:
    """A list or value state in memory that counts what is stored."""

    def __init__(self):
        self.rows, self.stored = [], 0

    def appendValue(self, row):  # noqa: N802
        self.rows, self.stored = [*self.rows, row], self.stored + 1

    def put(self, rows):
        self.rows, self.stored = list(rows), self.stored + len(rows)

    def update(self, row):
        self.put([row])

    def clear(self):
        self.rows = []

    def get(self):
        return iter(self.rows)


class Value(Stored):
    def get(self):
        return self.rows[0] if self.rows else None


def test_entries_and_rows_of_a_trial_are_few():
    """10,000 calls of a trial are three stored entries and one row, half of them wait for the next timer."""
    waiting, counts, timers = Stored(), Value(), []
    handle = SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: counts, registerTimer=timers.append)
    processor = trials.TrialProcessor(10**12)
    processor.init(handle)
    calls = [Row(trial="t", micros=1000 * (i * 7 % 10_000), number=i, tool="read_file") for i in range(10_000)]
    assert list(processor.handleInputRows(("t",), iter(calls), None)) == []
    assert (waiting.stored, timers) == (3, [0])
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    first = list(processor.handleExpiredTimer(("t",), clock(4999), None))
    assert len(first) == 1 and len(first[0].numbers) == 5000 and len(waiting.rows) == 1
    last = list(processor.handleExpiredTimer(("t",), clock(10**7), None))
    assert len(last) == 1 and not waiting.rows
    numbers, n = first[0].numbers + last[0].numbers, trials.FEATURES.index("n")
    assert [i * 7 % 10_000 for i in numbers] == list(range(10_000))
    assert last[0].features[n :: len(trials.FEATURES)] == list(range(5001, 10_001))
