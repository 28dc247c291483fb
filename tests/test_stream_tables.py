"""Streams into tables: upserted memories with replays and late rows, the cycle log; SQL table functions."""

import random

import pytest
from pyspark.sql import functions as F

from episodeframe import sqlreg
from episodeframe.operators import windows
from episodeframe.streaming import tables

RECORDS = "trial_id string, task_path string, score double, ord bigint, tool_sequence array<string>"


def plain(rows):
    """What the table should hold: last row of each key, classes and flags of the task."""
    last = {}
    for r in rows:
        t, p, s, o, _ = r
        if t is None or p is None:
            continue
        if (p, t) not in last or o >= last[p, t][3]:
            last[p, t] = r
    low = {p for (p, _), r in last.items() if r[2] < 0.5}
    kind = lambda s: "high" if s >= 0.75 else "medium" if s >= 0.25 else "low"
    return sorted((p, t, r[2], r[3], kind(r[2]), kind(r[2]) == "high" and p in low) for (p, t), r in last.items())


def stored(table):
    return sorted(map(tuple, table.read().select("task_path", "trial_id", "score", "ord", "outcome_class", "is_recoverable_high").collect()))


def test_upserts_replays_and_late_rows(spark, tmp_path):
    r = random.Random(3)
    table = tables.MemoryTable(spark, str(tmp_path / "memories"), buckets=3)
    with pytest.raises(ValueError):
        table.read()
    seen = []
    for number in range(4):
        batch = [(f"t{r.randrange(20)}", f"task-{r.randrange(6)}", r.choice([0.0, 0.5, 0.9]), 100 * number + i - 150 * (i % 7 == 0), ["edit"]) for i in range(15)] + [(None, "task-1", 1.0, 1, None), ("t1", None, 1.0, 1, None)]
        frame = spark.createDataFrame(batch, RECORDS)
        table.upsert(frame, number)
        seen += batch
        assert stored(table) == plain(seen)
        table.upsert(frame, number)  # played again
        assert stored(table) == plain(seen)
    # A first low run of a task marks its older high runs.
    table.upsert(spark.createDataFrame([("new", "lone", 0.9, 1, None)], RECORDS), 4)
    assert ("lone", "new", 0.9, 1, "high", False) in stored(table)
    table.upsert(spark.createDataFrame([("late", "lone", 0.1, 0, None)], RECORDS), 5)
    assert ("lone", "new", 0.9, 1, "high", True) in stored(table)
    before = stored(table)
    table.upsert(spark.createDataFrame([], RECORDS), 6)
    assert table.vacuum(1) > 0 and stored(table) == before and table.vacuum(1) == 0


def test_stream_of_memories(spark, tmp_path):
    rows = [[(f"t{i % 4}", f"task-{i % 2}", i % 5 / 4, 10 * n + i, ["edit"]) for i in range(6)] for n in range(3)]
    source, table = str(tmp_path / "in"), tables.MemoryTable(spark, str(tmp_path / "memories"))
    spark.createDataFrame([], RECORDS).write.parquet(source)
    stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(source)
    for part in rows:
        spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(source)
        table.stream(stream, str(tmp_path / "log"), availableNow=True).awaitTermination()
    assert stored(table) == plain([r for part in rows for r in part])


def test_cycle_log_of_a_stream(spark, tmp_path):
    r = random.Random(4)
    rows = [(a, c, round(0.5 + 0.02 * r.random(), 4)) for a in "xyz" for c in range(9)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "agent string, cycle int, kappa double"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = tables.stream_cycle_log(spark.readStream.schema(schema).parquet(source))
    for lo in range(0, 9, 3):
        part = [x for x in rows if lo <= x[1] < lo + 3]
        late = [("x", 0, 0.9)] if lo else []
        r.shuffle(part)
        spark.createDataFrame(part + late, schema).write.mode("append").parquet(source)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(target).select("agent", "cycle", "kappa", F.round("delta", 9), "plateaued")
    want = windows.kappa_changes(spark.createDataFrame(rows, schema), ["agent"]).select("agent", "cycle", "kappa", F.round("delta", 9), "plateaued")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sql_functions(spark):
    names = sqlreg.register(spark)
    assert {"iqm", "cvar", "outcome_entropy", "tool_prefixes", "script_checkpoints", "pass_at_k"} <= set(names)
    one = spark.sql("SELECT iqm(s, n) AS i, cvar(s, n, double(0.1)) AS c, outcome_entropy(s, n) AS e FROM VALUES (0.0D, 2), (1.0D, 2), (double(NULL), 5) AS t(s, n)").head()
    assert (one["i"], one["c"]) == (0.5, 0.0) and one["e"] == pytest.approx(0.6931471805599453)
    none = spark.sql("SELECT iqm(s, n) AS i FROM VALUES (double(NULL), 5) AS t(s, n)").head()
    assert none["i"] is None
    script = "# has the file\nif test -f out.txt; then\n  SCORE=$((SCORE + 2))\nfi\necho \"$SCORE / 4\"\n"
    spark.createDataFrame([("a", script), ("b", ""), ("c", None)], "task string, text string").createOrReplaceTempView("scripts")
    rows = spark.sql("SELECT s.task, c.score_increment, c.task_name FROM scripts s, LATERAL script_checkpoints(s.task, s.text) c").collect()
    assert [tuple(r) for r in rows] == [("a", 2, "a")]
    calls = spark.createDataFrame([("t", 2, "write_file"), ("t", 1, "read_file"), ("u", 1, "search_tool")], "trial_id string, event_id bigint, tool string")
    got = spark.sql("SELECT trial_id, event_id, prefix_len, n_reads, first_write_pos FROM tool_prefixes(TABLE(SELECT * FROM {calls}) PARTITION BY trial_id ORDER BY event_id)", calls=calls).collect()
    assert sorted(map(tuple, got)) == [("t", 1, 1, 1, 1), ("t", 2, 2, 1, 1), ("u", 1, 1, 0, 1)]
