import glob
import json

import pytest

from pyspark.sql import functions as F

from episodeframe import catalog, catalog_plans, catalog_sources  # noqa: F401  (the others register more queries)
from episodeframe.frame import Episodes
from episodeframe.operators import scans
from episodeframe.sources import checkpoints, generic, jobs, logs, stores

GOOD = {"run_id": "r", "model": "m", "task": "t", "score": 0.9, "difficulty": "hard", "seed": 7, "flag": True, "tags": ["x"]}


def test_validate(spark):
    bad = [{}, {**GOOD, "score": "high"}, {**GOOD, "score": True}, {**GOOD, "score": 1.2}, {**GOOD, "episode": "0"}, {**GOOD, "metadata": []}, {**GOOD, "failure_mode": None, "length": None}, GOOD]
    e = generic.validate(spark, bad)
    assert len(e[0]) == 4 and "must be a number" in e[1][0] and "must be a number" in e[2][0] and "between" in e[3][0]
    assert "int" in e[4][0] and "object" in e[5][0] and e[6] == [] and e[7] == []


def test_defaults_and_strata(spark):
    rows = generic.from_dicts(spark, [GOOD, {**GOOD, "score": 1.0}, {**GOOD, "success": True}]).df.orderBy("ord").collect()
    assert [r["success"] for r in rows] == [False, True, True]
    assert [r["failure_mode"] for r in rows] == ["below_threshold", None, None]
    assert rows[0]["strata"] == {"difficulty": "hard", "seed": "7"} and rows[0]["episode"] == 0


def test_strict_raises_and_lenient_skips(spark):
    with pytest.raises(Exception, match="invalid record"):
        generic.from_dicts(spark, [GOOD, {}]).df.collect()
    assert generic.from_dicts(spark, [GOOD, {}], strict=False).df.count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(GOOD) + "\n\n" + json.dumps(GOOD) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([GOOD, GOOD, GOOD]))
    (tmp_path / "c.json").write_text(json.dumps({"records": [GOOD]}))
    (tmp_path / "d.jsonl").write_text("{broken\n")
    assert [generic.read_generic(spark, str(tmp_path / n)).df.count() for n in ("a.jsonl", "b.json", "c.json")] == [2, 3, 1]
    with pytest.raises(Exception, match="not a JSON object"):
        generic.read_generic(spark, str(tmp_path / "d.jsonl")).df.collect()


def test_canonical_round_trip(spark, tmp_path):
    eps = Episodes.of(spark, [{"run_id": "r1", "model": "A", "task": "t1", "score": 0.75, "success": True, "strata": {"difficulty": "hard"}}, {"run_id": "r1", "model": "B", "task": "t2", "score": 0.5, "success": False, "failure_mode": "timeout"}])
    eps.write(str(tmp_path / "p"))
    assert generic.read_parquet(spark, str(tmp_path / "p")).slice(difficulty="hard").df.count() == 1
    eps.df.coalesce(1).write.json(str(tmp_path / "j"))
    back = generic.read_jsonl(spark, str(tmp_path / "j"))
    assert back.df.count() == 2 and back.slice(model="B").df.head()["failure_mode"] == "timeout"
    (tmp_path / "x.jsonl").write_text('{"run_id": "r", "nope": 1}\n')
    with pytest.raises(Exception, match="unknown fields"):
        generic.read_jsonl(spark, str(tmp_path / "x.jsonl")).df.collect()


def test_rewards(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('0.5\nnull\n{"a": 1, "b": 0}\n\n')
    assert [r["score"] for r in generic.read_rewards(spark, str(tmp_path / "r.jsonl")).orderBy("ord").collect()] == [0.5, None, 0.5]


def _trial(root, name, result=None, **files):
    d = root / "job" / name
    for path, text in {"result.json": json.dumps(result) if result is not None else None, **files}.items():
        if text is not None:
            (d / path).parent.mkdir(parents=True, exist_ok=True)
            (d / path).write_text(text)


def test_job_folder(spark, tmp_path):
    traj = json.dumps({"agent": {"name": "x"}, "steps": [{"tool_calls": [{"function_name": "read"}, {"function_name": "bash"}]}]})
    _trial(tmp_path, "a", {"task_name": "t1"}, **{"verifier/reward.json": '{"x": 1, "y": 0}', "verifier/reward.txt": "1", "config.json": '{"model": "m1", "lr": 3}', "agent/trajectory.json": traj})
    _trial(tmp_path, "b", {"task_name": "t1", "reward": 1.0})
    _trial(tmp_path, "c", {"task_id": "t2"}, **{"verifier/reward.txt": "1.0\n"})
    _trial(tmp_path, "d", {"agent_info": {"model": "m2"}})
    _trial(tmp_path, "e", None, **{"config.json": "{}"})
    tasks = tmp_path / "tasks" / "t1"
    tasks.mkdir(parents=True)
    (tasks / "task.toml").write_text('[task]\nname = "set/t1"\n[metadata]\ndifficulty = "hard"\ncategory = "c"\n')
    (tmp_path / "tasks" / "task.toml").write_text("broken = = toml")
    df = jobs.read_job(spark, str(tmp_path / "job"), strata_from_config=("lr",), tasks_dir=str(tmp_path / "tasks"))
    rows = {r["trajectory_ref"].rsplit("/", 1)[-1]: r for r in df.collect()}
    assert set(rows) == set("abcd")
    assert [rows[k]["score"] for k in "abcd"] == [0.5, 1.0, 1.0, 0.0]
    assert [rows[k]["failure_mode"] for k in "abcd"] == ["below_threshold", None, None, "missing_reward"]
    assert rows["a"]["strata"] == {"difficulty": "hard", "category": "c", "lr": "3"} and rows["b"]["episode"] == 1 and rows["d"]["task"] == "d" and rows["d"]["model"] == "m2"
    assert jobs.read_jobs(spark, [str(tmp_path / "job")] * 2).select("run_id").distinct().count() == 2
    t = jobs.read_trajectory_dirs(spark, [str(tmp_path / "job"), str(tmp_path)]).collect()
    assert len(t) == 2 and t[0]["tool_sequence"] == ["read_file", "run_shell_command"] and t[0]["agent_name"] == "x" and t[0]["first_write_pos"] == 1


def test_sample_log(spark, tmp_path):
    log = {"eval": {"model": "m", "run_id": "r9"}, "samples": [{"id": "s1", "score": {"value": "C"}, "metadata": {"level": "easy"}}, {"id": "s1", "score": "I"}, {"id": "s2", "score": 1.0, "error": {"type": "Timeout"}}, {"sample_id": 5, "score": 0.5, "epoch": 3}]}
    (tmp_path / "l.json").write_text(json.dumps(log))
    rows = logs.read_samples(spark, str(tmp_path / "l.json"), ("level",)).orderBy("ord").collect()
    assert [r["score"] for r in rows] == [1.0, 0.0, 1.0, 0.5] and [r["success"] for r in rows] == [True, False, False, False]
    assert [r["failure_mode"] for r in rows] == [None, "incorrect", "Timeout", "incorrect"] and [r["episode"] for r in rows] == [0, 1, 0, 3]
    assert rows[0]["strata"] == {"level": "easy"} and rows[3]["task"] == "5" and rows[0]["run_id"] == "r9"


def test_sample_logs_by_lines(spark, tmp_path):
    """Two documents of a ``.jsonl`` are what they are as a file each; the query writes no file a user."""
    docs = [{"eval": {"model": "m", "run_id": f"r{i}"}, "samples": [{"id": "s", "score": "C"}, {"id": "s", "score": 0.5, "error": {"type": "Limit"}}][: i + 1]} for i in range(2)]
    (tmp_path / "l.jsonl").write_text("\n\n".join(map(json.dumps, docs)) + "\n")
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    read = lambda p: sorted(map(str, logs.read_samples(spark, p).collect()))
    assert len(read(str(tmp_path / "l.jsonl"))) == 3 and read(str(tmp_path / "l.jsonl")) == read(str(tmp_path / "*.json"))
    spark.range(1000).selectExpr("id as event_id", "timestamp'2024-01-01' as ts", "id % 500 as user_id", "'view' as event_type", "0D as value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(glob.glob(f"{root}/samples_*"))
    found = catalog.QUERIES["sample_log"](spark, str(tmp_path))
    written = set(glob.glob(f"{root}/samples_*")) - before
    assert len(written) == 1 and len(glob.glob(f"{written.pop()}/**/part-*", recursive=True)) <= 4
    assert sorted((r["run_id"], r["episode"]) for r in found.collect()) == sorted((f"run_{u}", k) for u in range(500) for k in range(2))


def test_benchmark_predictions(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"instance_id": "i1", "trajectory": "t1.json"}\n{"instance_id": ""}\n{"instance_id": "i2"}\n')
    (tmp_path / "r.json").write_text('{"i1": {"resolved": true}}')
    (tmp_path / "tr").mkdir()
    (tmp_path / "tr" / "t1.json").write_text(json.dumps({"steps": [{"action": a} for a in ("read", "bash", "edit", "submit", "rm -rf x", "find y")]}))
    p, r, root = str(tmp_path / "p.jsonl"), str(tmp_path / "r.json"), str(tmp_path / "tr")
    assert [(x["task"], x["score"]) for x in logs.read_benchmark(spark, p, r).orderBy("ord").collect()] == [("i1", 1.0), ("i2", 0.0)]
    t = logs.read_benchmark_trajectories(spark, p, r, root).collect()
    assert len(t) == 1 and t[0]["tool_sequence"] == ["read_file", "run_shell_command", "write_file", "submit", "run_shell_command", "list_directory"]
    assert t[0]["first_write_pos"] == 2 and not t[0]["write_before_read"]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="must be an object"):
        logs.read_results(spark, str(tmp_path / "bad.json")).collect()


SCRIPT = """SCORE=0
# Check: output exists

if [ -f out ]; then
  SCORE=$((SCORE + 10))
fi

# {long}
python3 -c "assert 'k' in d" && SCORE=$[SCORE + 30]
SCORE=$(expr $SCORE + 60)
python3 -c "print($SCORE / 100.0)"
"""


def test_checkpoints(spark, tmp_path):
    d = tmp_path / "tasks" / "medium-9" / "tests"
    d.mkdir(parents=True)
    (d / "test.sh").write_text(SCRIPT.replace("{long}", "x" * 100))
    other = tmp_path / "tasks" / "none" / "tests"
    other.mkdir(parents=True)
    (other / "test.sh").write_text("echo no score")
    rows = checkpoints.read_checkpoints(spark, str(tmp_path / "tasks")).orderBy("index").collect()
    assert [(r["checkpoint_id"], r["score_increment"]) for r in rows] == [(f"medium-9::phase-{i}", n) for i, n in enumerate((10, 30, 60))]
    assert sum(r["reward_weight"] for r in rows) == pytest.approx(1) and len(rows[1]["description"]) == 80
    assert checkpoints.parse('echo "$SCORE / 5"', "t") == [("t", 0, "t::phase-0", "All-or-nothing task completion", 1.0, 5, 5, "")]


def test_stores(spark, tmp_path):
    from episodeframe.schema import MEMORY, POOL
    from episodeframe.sources import stores

    m = spark.createDataFrame([("t1", "task/a", "x", 1.0, ["read_file"], "p", 1, 1, 0, 0)], MEMORY)
    stores.write_memories(m, str(tmp_path / "m"))
    assert stores.read_memories(spark, str(tmp_path / "m")).collect() == m.collect()
    p = spark.createDataFrame([("A", "A", "t", 1.0, {"ck": 1.0}, None, True, None, 0, 0), ("B", "B", "t", 0.0, {}, None, False, "x", 0, 1)], POOL)
    stores.write_pool(p, str(tmp_path / "p"))
    assert stores.read_pool(spark, str(tmp_path / "p")).orderBy("ord").collect() == p.collect()
    (tmp_path / "bad.json").write_text('{"records": [{"agent_name": "A", "model_name": "A", "task": "t"}]}')
    with pytest.raises(Exception, match="missing required key 'score'"):
        stores.read_pool(spark, str(tmp_path / "bad.json")).collect()
    plan = spark.createDataFrame([("a", 0.5, 2), ("b", 0.7, 1)], "task string, gap double, position int")
    stores.write_plan(plan, str(tmp_path / "plan"))
    assert [r["task"] for r in stores.read_plan(spark, str(tmp_path / "plan"), plan.schema).collect()] == ["b", "a"]
    (tmp_path / "sim.json").write_text(json.dumps({"agents": {"A": {"right_tail": {"mean_gain": 0.1, "ci_low": 0.0, "ci_high": 0.2}}}}))
    assert stores.read_simulation(spark, str(tmp_path / "sim.json"), "A").head()["mean"] == 0.1
    assert stores.read_simulation(spark, str(tmp_path / "none.json"), "A") is None


def test_checkpoint_forms():
    """Every way to add and to state the total, in any spacing and case; what ends a guard and a description."""
    assert [checkpoints.additions(x) for x in ("SCORE=$((SCORE+2))", "  score = $(( SCORE + 30 ))", "SCORE=$[SCORE + 4]", "SCORE=$( expr $SCORE + 5 )", "SCORE=0", "SCORE=$((SCORE+x))", "a && SCORE=$((SCORE+1)); SCORE=$((SCORE+2))")] == [[2], [30], [4], [5], [], [], [1, 2]]
    assert [checkpoints.stated_total(x) for x in ('python3 -c "print($SCORE / 100.0)"', "python3 -c 'print($SCORE/7)'", 'echo "$SCORE / 5"', "echo $TOTAL")] == [100, 7, 5, None]
    text = "\n".join(["# Check: first part", "", "SCORE=$((SCORE + 1))", "if [ ! -f x ]; then", "  exit 1", "fi", "cd x", "run it", "SCORE=$((SCORE + 3))", "python3 -c \"assert d['k'] == 1\" && SCORE=$((SCORE+4))", "python3 -c \"assert 'z' in d\"", "SCORE=$((SCORE+2))"])
    rows = checkpoints.parse(text, "t")
    assert [r[3] for r in rows] == ["first part", "Checkpoint", "Checkpoint", "Key z present"]
    assert [r[7] for r in rows] == ["", "exit 1\nfi\ncd x\nrun it", "", "python3 -c \"assert 'z' in d\""]
    assert [r[5] for r in rows] == [1, 3, 4, 2] and rows[0][6] == 10
    with pytest.raises(ValueError, match="no score"):
        checkpoints.parse("echo hi", "t")


def test_order_over_jobs_and_files(spark, tmp_path):
    """Trials of several tasks in two jobs, and lines of several files, have one order without ties."""
    for job in ("j1", "j2"):
        for k in range(4):
            d = tmp_path / job / f"trial-{k}"
            (d / "verifier").mkdir(parents=True)
            (d / "result.json").write_text(json.dumps({"task_name": f"t{k % 2}", "trial_name": f"trial-{k}"}))
            (d / "config.json").write_text("{}")
            (d / "verifier" / "reward.txt").write_text(str(k / 4))
    rows = jobs.read_jobs(spark, [str(tmp_path / "j1"), str(tmp_path / "j2")]).orderBy("ord").collect()
    assert len({r["ord"] for r in rows}) == 8
    assert [(r["run_id"], r["trajectory_ref"].rsplit("/", 1)[-1]) for r in rows] == [(j, f"trial-{k}") for j in ("job0", "job1") for k in range(4)]
    folder = tmp_path / "in"
    folder.mkdir()
    record = lambda n: {"run_id": "r", "model": "m", "task": "t", "score": n / 10}
    (folder / "b.json").write_text(json.dumps([record(3), record(4)]))
    (folder / "a.json").write_text(json.dumps({"records": [record(n) for n in range(3)]}))
    got = generic.read_generic(spark, str(folder)).df.orderBy("ord").collect()
    assert [r["score"] for r in got] == [n / 10 for n in range(5)] and len({r["ord"] for r in got}) == 5
    generic.from_dicts(spark, [record(n) for n in range(5)]).write_jsonl(str(tmp_path / "out"))
    back = generic.read_jsonl(spark, str(tmp_path / "out")).df.orderBy("ord").collect()
    assert [(r["score"], r["task"]) for r in back] == [(n / 10, "t") for n in range(5)]


def test_documents_of_many_parts(spark, tmp_path):
    """A pool written by several tasks is one document when its parts are put together, and reads back equal."""
    import json

    from pyspark.sql import functions as F

    from episodeframe.schema import POOL
    from episodeframe.sources import stores

    n = 3000
    pool = spark.range(n).repartition(5).select(
        F.concat(F.lit('a"g\n'), F.col("id") % 3).alias("agent_name"), F.lit("m").alias("model_name"), F.concat(F.lit("täsk,"), F.col("id") % 700).alias("task"), (F.col("id") % 11 / 10).alias("score"), (n - F.col("id")).alias("ord"),
        F.create_map(F.lit("ck[0]"), F.lit(0.5)).alias("checkpoint_scores"), (F.col("id") % 2 == 0).alias("success"), F.lit(0).alias("sub_task_depth"),
    )
    for f in POOL:
        pool = pool.withColumn(f.name, F.col(f.name).cast(f.dataType) if f.name in pool.columns else F.lit(None).cast(f.dataType))
    pool = pool.select(*POOL.names)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stores.write_pool(pool, str(tmp_path / "pool"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "pool").glob("part-*"))
    assert len(parts) > 1
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole["n_records"] == n and whole["agents"] == ['a"g\n0', 'a"g\n1', 'a"g\n2'] and len(whole["tasks"]) == 700
    assert [r["ord"] for r in whole["records"]] == list(range(1, n + 1))
    key = lambda df: sorted(map(str, df.orderBy("ord").collect()))
    assert key(stores.read_pool(spark, str(tmp_path / "pool"))) == key(pool)
    # The same document in one piece, laid out otherwise.
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=1))
    assert key(stores.read_pool(spark, str(tmp_path / "one.json"))) == key(pool)
    stores.write_pool(pool.limit(0), str(tmp_path / "none"))
    assert stores.read_pool(spark, str(tmp_path / "none")).collect() == []
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"n_records": 0, "agents": [], "tasks": [], "records": []}


def test_bad_lines_by_file_and_line(spark, tmp_path):
    """Lines count from 1 in their own file, blank ones too, over files that are read in many parts."""
    folder = tmp_path / "in.jsonl"
    folder.mkdir()
    line = lambda i: json.dumps({"run_id": "r", "model": "m", "task": "t" * (i % 90 + 1), "score": 0.5})
    bad = {"a.jsonl": [1, 150, 399, 400], "b.jsonl": [77], "c.jsonl": []}
    for name, places in bad.items():
        (folder / name).write_text("".join(("{broken" if n in places else "" if n % 13 == 0 else line(n)) + "\n" for n in range(1, 401)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = generic.bad_lines(spark, str(folder)).collect()
        assert sorted((r["file"].rsplit("/", 1)[-1], r["line"]) for r in found) == [(f, n) for f, p in bad.items() for n in p]
        with pytest.raises(ValueError, match="a.jsonl, line 1: not a JSON object; .*a.jsonl, line 150"):
            generic.read_generic(spark, str(folder), eager=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert generic.read_generic(spark, str(folder / "c.jsonl"), eager=True).df.count() == 400 - 400 // 13


def test_job_source_partitions_sink_and_stream(spark, tmp_path):
    """Trials over many tasks keep their order; the sink writes what the reader reads; a stream takes each trial once."""
    from episodeframe.sources import job_source

    job = str(tmp_path / "job")
    rows = [(f"t{i:03}", json.dumps({"task_name": f"k{i % 3}", "reward": i / 100}) if i % 5 else None, "{}", "é\n" * i if i % 2 else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "trial string, result string, config string, trajectory string").repartition(4)
    job_source.write_job(frame, job)
    job_source.write_job(frame, job)  # a second time leaves the same files
    assert not [p for p in (tmp_path / "job").rglob("*") if p.is_file() and p.name not in ("result.json", "config.json", "trajectory.json")]
    read = spark.read.format("agent_jobs").option("trials_per_task", 7).option("kinds", "trajectory,config").load(job)
    assert read.rdd.getNumPartitions() == 6 and read.columns == ["run", "job", "trial", "place", "trajectory", "config"]
    got = read.collect()
    assert [(r["trial"].rsplit("/", 1)[-1], r["place"], r["trajectory"]) for r in got] == [(t, i, x) for i, (t, result, _, x) in enumerate(rows) if result]
    assert jobs.read_job(spark, job).orderBy("ord").select("task", "score", "episode").collect()[:3] == [("k1", 0.01, 0), ("k2", 0.02, 0), ("k0", 0.03, 0)]
    target, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        stream = jobs.stream_jobs(spark, [job], settle=0.0)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["task"], r["score"]) for r in spark.read.schema(stream.schema).parquet(target).collect())

    first = sorted((f"k{i % 3}", i / 100) for i in range(40) if i % 5)
    assert run() == first and run() == first
    job_source.write_job(spark.createDataFrame([("a-new-one", '{"task_name": "k9", "reward": 1.0}')], "trial string, result string"), job)
    assert run() == sorted([*first, ("k9", 1.0)])
    (tmp_path / "none").mkdir()
    assert jobs.read_job(spark, str(tmp_path / "none")).count() == 0 and jobs.read_trajectory_dirs(spark, [str(tmp_path / "absent")]).count() == 0
    for wrong in (frame.withColumnRenamed("config", "other"), frame.drop("trial")):
        with pytest.raises(Exception, match="no file for|has the columns"):
            job_source.write_job(wrong, job)
    with pytest.raises(Exception, match="not the name of a trial"):
        job_source.write_job(frame.limit(1).selectExpr("'../x' as trial", "config"), job)


def test_document_of_long_values(spark, tmp_path, monkeypatch):
    """Rows are dealt by the beginning of a value; equal places still go by the whole of it."""
    dealt = []
    plain = scans.ranged
    monkeypatch.setattr(scans, "ranged", lambda df, order, ties=(): dealt.append(df.select(*order)) or plain(df, order, ties))
    values = [f'{{"a":"{"x" * 5000}{i % 7}"}}' for i in range(40)]
    rows = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "place int, value string").repartition(3)
    stores.write_document([('{"l":[', rows)], "]}", str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert [json.dumps(x, separators=(",", ":")) for x in json.loads(text)["l"]] == [v for _, v in sorted((i % 3, v) for i, v in enumerate(values))]
    assert all(len(x) <= stores.BEGINNING for row in dealt[0].collect() for x in row if isinstance(x, str))


def test_order_of_files_and_parts(spark, tmp_path):
    """Places ascend over files by name and lines, also where files are read in parts, and no line is dealt out."""
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i:04d}\n" + ("\n" if i % 5 == 0 else "") for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = generic.in_file_order(spark.read.text(str(tmp_path / "*.txt")))
        assert [r["value"] for r in sorted(found.collect(), key=lambda r: r["place"])] == [f"{n}{i:04d}" for n in "abc" for i in range(300)]
        assert found.select("place").distinct().count() == 900
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and not any(line.lstrip(" :+-").startswith("Sort [_file") for line in plan.splitlines())


def test_records_are_parsed_once(spark):
    """A filter on the errors doesn't parse the text again for every rule."""
    raw = spark.createDataFrame([('{"run_id":"r","model":"m","task":"t","score":0.5}', 0), ("[1]", 1), ("{", 2)], "value string, ord bigint")
    bad = generic.convert(raw, order="ord").where(F.size("errors") > 0).select("ord", "errors")
    assert bad._jdf.queryExecution().optimizedPlan().toString().lower().count("try_parse_json") + bad._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
    assert {r["ord"]: r["errors"][0] for r in bad.collect()} == {1: "record must be an object", 2: "not a JSON object"}
