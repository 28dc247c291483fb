import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodeframe import sqlreg
from episodeframe.frame import Episodes
from episodeframe.operators import taxonomy, trajectory
from episodeframe.plans import control, curriculum, cyclelog, environments, harness, recursion, report, simulation
from episodeframe.streaming import monitor


def eps(spark, scores):
    return Episodes.of(spark, [{"run_id": "r0", "model": "A", "task": t, "episode": i, "score": float(s), "success": s >= 0.99} for t, ss in scores.items() for i, s in enumerate(ss)]).df


def test_effect_model(spark):
    df = eps(spark, {"A": [0, 1], "B": [1, 1], "C": [0, 0]})
    prof = taxonomy.task_profiles(df)
    new = lambda sel, s: {(r["task"], r["episode"]): r["new_score"] for r in simulation.apply_training_effect(df, sel, prof, s).collect()}
    generic = new(df.where("task = 'A'"), "generic")
    assert generic["A", 0] == pytest.approx(0.1) and generic["B", 0] == 1 and generic["C", 0] == 0
    paired = new(simulation.select_right_tail(df, prof, 5), "right_tail")
    assert paired["A", 0] == pytest.approx(0.3) and paired["A", 1] == 1
    assert [r["score"] for r in simulation.select_mean_reward(df, 2).collect()] == [1.0, 1.0]
    assert simulation.select_random(df, 3, 1).count() == 3
    assert simulation.optimal_training_amount() == {"t_star": pytest.approx(2.0), "peak_frac": pytest.approx(0.6)}
    assert df.select(simulation.overoptimized_gain(F.lit(0.5), F.lit(2.0))).head()[0] == pytest.approx(0.3)
    assert simulation.pct_improvement(1, 0) == float("inf") and simulation.efficiency_pct_improvement(5, 10) == 50


def test_monte_carlo(spark):
    df = eps(spark, {"A": [0, 1, 1], "B": [0.2, 0.9, 0.4], "C": [0, 0, 0]})
    g = simulation.simulate_gains(df, 200)
    res = {r["strategy"]: r["mean"] for r in simulation.strategy_results(g).collect()}
    assert res["right_tail"] > res["random"] > 0 and simulation.win_probability(g).head()["p_better"] > 0.5
    r = {x["strategy"]: x["mean"] for x in simulation.strategy_results(simulation.simulate_rounds(df, 20), "rounds").collect()}
    assert 0 < r["right_tail"] <= 50
    out = simulation.simulate_recursive_gains({"s1": [0, 1], "s2": [1, 1], "s3": [0, 0]}, {"s1": "recoverable", "s2": "solid", "s3": "stuck"})
    assert np.mean(out["s1"]) > 0.5 and out["s2"] == [1, 1] and out["s3"] == [0, 0]


def test_control(spark):
    tasks = [control.CurriculumTask("t1", 0.4, 0.5), control.CurriculumTask("t2", 0.1, 0.5)]
    assert control.CurriculumValueIterator(tasks).plan([0.5, 0.5], 2)[0] == "t1"
    mpc = control.MPCCurriculumPlanner(spark, tasks, horizon=3)
    best, value = mpc.solve([0.5, 0.5])

    def brute(seq):
        k, total = [0.5, 0.5], 0.0
        for t, a in enumerate(seq):
            reward = 0.4 * tasks[a].gap * (1 - k[a])
            total += 0.99**t * reward
            k[a] = min(1.0, k[a] + reward / tasks[a].gap)
        return total

    import itertools

    want = max(itertools.product(range(2), repeat=3), key=brute)
    assert best == want and value == pytest.approx(brute(want)) and mpc.next_action([0.5, 0.5]) == 0
    rng = np.random.default_rng(0)
    x, r = rng.normal(size=(6, 3)), rng.normal(size=6)
    s = control.ThompsonSamplingScheduler(3, 2.0, 0.1)
    for a, b in zip(x, r, strict=True):
        s.update(a, b)
    ridge = np.linalg.solve(np.eye(3) / 2 + x.T @ x / 0.01, x.T @ r / 0.01)
    assert s.mu == pytest.approx(ridge)
    both = control.ThompsonSamplingScheduler(3, 2.0, 0.1)
    both.update_from(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, r, strict=True)], "x double, y double, z double, r double"), ["x", "y", "z"], "r")
    assert both.mu == pytest.approx(ridge)
    assert {t.task_id for t in s.__class__(4).rank(tasks)} == {"t1", "t2"}
    bo = control.BayesianOptimizer([control.SearchSpace("x", -2, 2)], "ucb", n_init=4, seed=1)
    assert bo.optimize(lambda v: -((v[0] - 0.7) ** 2), 14)["best_params"]["x"] == pytest.approx(0.7, abs=0.2)
    sched = control.BayesianCurriculumScheduler()
    assert sched.rank(tasks)[0].task_id == "t1"
    for t, g in zip(tasks, (0.0, 0.5), strict=True):
        sched.observe(t, g)
    sched.fit()
    assert sched.predict_gain(tasks[1])[0] > sched.predict_gain(tasks[0])[0]


def test_curriculum(spark):
    prof = taxonomy.task_profiles(eps(spark, {"set/a": [0, 1, 0.5], "b": [1, 1], "c": [0, 0]}))
    runs = spark.createDataFrame([("tasks/a", 1.0, "p1"), ("tasks/a", 0.0, "p2"), ("tasks/a", 0.5, "p3"), ("tasks/b", 1.0, "p4")], "task_path string, score double, traj_path string")
    pairs = curriculum.training_pairs(runs, prof)
    assert sorted((p["reinforce_path"], p["contrast_path"]) for p in pairs.collect()) == [("p1", "p2"), ("p1", "p3")]
    plan = curriculum.build_plan(prof, pairs)
    row = plan.head()
    assert plan.count() == 1 and row["predicted_gain"] == pytest.approx(0.4 * 0.5 * 0.5) and "2 pair(s)" in row["recommendation"] and row["position"] == 1
    ex = curriculum.preference_examples(plan)
    assert ex.count() == 2 and curriculum.simulated_training(plan).head()["score"] == 1.0
    weights = spark.createDataFrame([("p1", "write_file", 1.0)], "traj_path string, tool string, weight double")
    assert curriculum.diverse(pairs, weights, 0.9).count() == 1
    s = curriculum.plan_summary(plan, taxonomy.right_tail(prof)).head()
    assert s["n_recoverable"] == 1 and not s["cycle_complete"] and s["predicted_total"] == pytest.approx(0.1)
    assert curriculum.accumulate(runs, runs.limit(2), ["traj_path"]).count() == 4
    assert "rl: dpo" in curriculum.trainer_config("m", "d.jsonl", "out")


def test_recursion_and_environments(spark, tmp_path):
    df = eps(spark, {"easy-1": [0, 0, 0], "medium-2": [0.8, 0.5, 0.6], "done": [1, 1]})
    prof = taxonomy.with_scores(taxonomy.task_profiles(df), df)
    found = spark.createDataFrame([("easy-1", [(1, "read", 0.9), (3, "write", 0.9), (5, "exec", 0.9)]), ("medium-2", [(1, "read", 0.9), (3, "write", 0.9)])], "task string, found array<struct<exit_step:int,phase_tag:string,confidence:double>>")
    specs = spark.createDataFrame([("medium-2", i, f"medium-2::phase-{i}", f"part {i}", w, "test -f x") for i, w in enumerate([0.1, 0.25, 0.25, 0.2, 0.2])], "task_name string, index int, checkpoint_id string, description string, reward_weight double, condition_source string")
    subs = recursion.decompose(prof, found, specs).cache()
    rows = subs.collect()
    med = [r for r in rows if r["parent_task"] == "medium-2"]
    assert sum(r["weight"] for r in med) == pytest.approx(1) and len(med) == 5 and {r["kind"] for r in rows if r["parent_task"] == "easy-1"} == {"stuck"}
    assert "done" not in {r["parent_task"] for r in rows} and max(r["sub_task_depth"] for r in rows) <= 3
    assert [r["kind"] for r in sorted(med, key=lambda r: r["phase"])] == ["solid", "solid", "recoverable", "recoverable", "stuck"]
    gaps = {r["task"]: r["recursive_gap"] for r in recursion.recursive_gaps(subs).collect()}
    assert gaps["medium-2"] > 0 and gaps["easy-1"] == 0
    assert json.loads(recursion.to_json(subs).where("parent_task = 'medium-2'").head()["graph"])["sub_tasks"][0]["phase"] == 0
    d = tmp_path / "tasks" / "medium-2"
    d.mkdir(parents=True)
    (d / "seed.json").write_text("{}")
    (d / "test.sh").write_text("x")
    envs = environments.generate(subs, environments.task_files(spark, str(tmp_path / "tasks")))
    e = envs.where("task_id = 'medium-2::phase-0'").head()
    assert e["reward"]["type"] == "checkpoint" and e["reward"]["verifier_command"] == "cd tasks/medium-2 && bash -c 'test -f x'" and e["initial_state"]["files"] == {"seed.json": "{}"} and e["termination"]["success_threshold"] == 0.99
    reg = environments.Registry(envs.limit(0)).register(envs).register(envs)
    assert reg.df.count() == len(rows) and reg.by_parent("medium-2").count() == 5
    reg = reg.retire("medium-2::phase-0").recompute_status(spark.createDataFrame([("medium-2::phase-1", "solid")], "task string, kind string"))
    assert reg.active().count() == len(rows) - 1 and reg.get("medium-2::phase-1").head()["metadata"]["status"] == "solid"
    reg.export(str(tmp_path / "reg"))
    assert environments.Registry.load(spark, str(tmp_path / "reg"), reg.df.schema).df.count() == len(rows) - 1


def test_log_harness_report(spark, tmp_path):
    df = eps(spark, {"A": [0, 1], "B": [1, 1]}).withColumn("s_level", F.lit("x"))
    prof = taxonomy.task_profiles(df)
    log = cyclelog.CycleLog(spark, str(tmp_path / "log"))
    log.append(0, prof)
    log.append(1, prof)
    log.append(2, prof.limit(0))
    c = log.cycles().orderBy("cycle").collect()
    assert len(c) == 2 and c[1]["delta"] == 0 and c[1]["plateaued"]
    log.export_csv(str(tmp_path / "csv"))
    h = harness.AgentHarness(harness.NoOpAgent())
    rows = h.run_batch(spark, [harness.TaskSpec("t1", difficulty="hard"), harness.TaskSpec("t2")], 2).collect()
    assert len(rows) == 4 and all(r["success"] for r in rows) and {r["ord"] for r in rows} == {0, 1, 2, 3}
    assert harness.run_repeated(lambda i: df, 2).select("run_id").distinct().count() == 2
    two = df.unionByName(df.withColumns({"model": F.lit("Z"), "score": F.col("score") / 2, "success": F.lit(False)}))
    s = report.save_summary(two, str(tmp_path / "s.json"))
    assert s["overall"]["n_episodes"] == 8 and len(s["leaderboard"]) == 2 and json.loads((tmp_path / "s.json").read_text())
    assert report.compare_models(two, "A", "Z")["n_won_a"] >= 4 and "pass_at_1" in report.text_report(two)
    assert {n: t.count() > 0 for n, t in report.plot_tables(two).items()} and report.save_plots(two, str(tmp_path)) == []


def test_sql_functions(spark):
    sqlreg.register(spark)
    assert spark.sql("SELECT pass_at_k(4, 2, 2), pass_hat_k(4, 2, 2), outcome_kind(1, 0.5), consistency(0, 0), size(task_words('A b, a'))").head()[:] == (pytest.approx(5 / 6), pytest.approx(1 / 6), "recoverable", 0.0, 2)


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{i:02}", i, t) for i, t in enumerate(["read_file", "write_file", "run_shell_command", "search_tool"])] + [("b", "2024-01-01 00:01:00", 9, "read_file")]
    calls = spark.createDataFrame(rows, "trial_id string, ts string, event_id int, tool string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        calls.where(F.col("event_id") % 9 < 2 if i == 0 else F.col("event_id") % 9 >= 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor.stream_prefixes(src).writeStream.format("memory").queryName("prefixes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["trial_id"], r["event_id"]): r for r in spark.table("prefixes").collect()}
    want = trajectory.prefix_features(calls, "trial_id", ["ts", "event_id"]).collect()
    assert len(got) == len(want) == 5
    for w in want:
        g = got[w["trial_id"], w["event_id"]]
        for c in ("prefix_len", "n_reads", "n_writes", "n_exec", "n_search", "first_write_pos", "first_exec_pos", "search_ratio", "tool_diversity", "write_before_read"):
            assert g[c] == w[c], c
    rows = [("t", f"2024-01-01 00:00:{i:02}", float(i % 2)) for i in range(4)]
    scores = spark.createDataFrame(rows, "task string, ts string, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    scores.coalesce(1).write.parquet(str(tmp_path / "scores"))
    src = spark.readStream.schema(scores.schema).parquet(str(tmp_path / "scores"))
    monitor.stream_confidence(src).writeStream.format("memory").queryName("conf").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    r = spark.table("conf").head()
    assert r["t"] == 4 and r["running_mean"] == 0.5 and r["running_lo"] == 0 and r["running_hi"] == 1


def _flat_rounds(flat, s, k, strategy, rng):
    for i in range(simulation.MAX_ROUNDS):
        if s.mean() >= simulation.THRESHOLD:
            return i
        s = flat.train(s, flat.select(s, k, strategy, rng), strategy)
    return simulation.MAX_ROUNDS


def test_simulation_by_counts():
    """Replicates of counts are distributed as those of single episodes."""
    rng = np.random.default_rng(3)
    task = np.repeat(np.arange(4), [30, 40, 25, 35])
    score = np.round(rng.random(len(task)) ** 2, 1)
    keys, n = np.unique(np.stack([task, score]), axis=1, return_counts=True)
    cells, flat = simulation.Cells(keys[0].astype(int), keys[1], n), simulation.Tables(task, score)
    a, b = {x: [] for x in simulation.STRATEGIES}, {x: [] for x in simulation.STRATEGIES}
    for _ in range(1500):
        s, m, first = cells.resample(rng, 5)
        assert m.sum() == len(task) and (np.isfinite(first).sum(1) == np.minimum(m, 5)).all()
        t = flat.score[flat.first[flat.task] + (rng.random(len(task)) * flat.size[flat.task]).astype(int)]
        for x in simulation.STRATEGIES:
            a[x].append((cells.rounds(s, m, first, 5, x, simulation.THRESHOLD, simulation.MAX_ROUNDS, rng), cells.mean(cells.train(s, m, cells.select(s, m, first, 5, x, rng), x), m) - cells.mean(s, m)))
            b[x].append((_flat_rounds(flat, t, 5, x, rng), flat.train(t, flat.select(t, 5, x, rng), x).mean() - t.mean()))
    for x in simulation.STRATEGIES:
        one, two = np.array(a[x]), np.array(b[x])
        error = np.sqrt((one.var(0) + two.var(0)) / len(one))
        assert (np.abs(one.mean(0) - two.mean(0)) <= 4 * error + 1e-12).all(), x
        assert np.abs(np.bincount(one[:, 0].astype(int), minlength=51) - np.bincount(two[:, 0].astype(int), minlength=51)).sum() / 2 < 0.08 * len(one), x
        assert one[:, 1].std() == pytest.approx(two[:, 1].std(), rel=0.12, abs=1e-3)


def test_simulation_of_many_episodes(spark):
    """The bound is one of different scores, not of episodes."""
    df = spark.range(5000).selectExpr("concat('t', id % 3) as task", "(id % 7) / 10.0D as score")
    found = simulation.simulate_rounds(df, 4, most=30)
    assert found.count() == 12
    assert simulation.simulate_gains(df, 4, most=30).where("gain >= 0").count() == 12
    with pytest.raises(ValueError, match="different scores"):
        simulation.simulate_gains(df, 4, most=20)
