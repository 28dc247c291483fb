import json

import pytest

from episodeframe.__main__ import main
from episodeframe.frame import Episodes
from episodeframe.plans import curriculum, cycle, cyclelog, trainers
from episodeframe.plans.recursion import RecursionConfig

TOOLS = {"good": ["read_file", "write_file", "run_shell_command", "write_file", "run_shell_command"], "bad": ["search_tool"] * 8}


def episodes(spark, scores):
    return Episodes.of(spark, [{"run_id": "r0", "model": "A", "task": t, "episode": i, "score": float(s), "success": s >= 0.99} for t, ss in scores.items() for i, s in enumerate(ss)]).df


@pytest.fixture(scope="module")
def table(spark):
    return episodes(spark, {"a": [0, 1, 0.5], "b": [1, 1], "c": [0, 0], "d": [0.2, 0.6]})


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(f"tasks/{t}", f"{t}-{i}", float(s), TOOLS["good" if s >= 0.5 else "bad"], f"p/{t}-{i}") for t, ss in {"a": [0, 1, 0.5], "b": [1, 1], "c": [0, 0]}.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "task_path string, trial_id string, score double, tool_sequence array<string>, traj_path string")


def test_cycle_without_runs(spark, table):
    made = cycle.run_cycle(table, agent="x", cycle=3)
    o = made.overview.head()
    assert (o["agent"], o["cycle"], o["n_tasks"], o["n_solid"], o["n_recoverable"], o["n_stuck"], o["n_planned"], o["cycle_complete"]) == ("x", 3, 4, 1, 2, 1, 2, False)
    assert o["consistency_index"] == pytest.approx((0.5 + 1 + 0.4) / 2.6) and o["recoverable_score_left"] == pytest.approx(0.7)
    plan = made.plan.orderBy("position").collect()
    assert [(r["task"], r["training_pairs"], r["divergence_step"]) for r in plan] == [("a", None, 0), ("d", None, 0)] and made.sub_tasks is None
    nothing = cycle.run_cycle(table.where("false")).overview.head()
    assert (nothing["n_tasks"], nothing["n_planned"], nothing["consistency_index"], nothing["cycle_complete"], nothing["predicted_total"]) == (0, 0, 1.0, True, None)


def test_cycle_with_runs(spark, table, runs, tmp_path):
    log = cyclelog.CycleLog(spark, str(tmp_path / "log"), "x")
    made = cycle.run_cycle(table, runs, recursive=RecursionConfig(), log=log)
    a = made.plan.where("task = 'a'").head()
    assert [(p["reinforce_path"], p["contrast_path"]) for p in a["training_pairs"]] == [("p/a-1", "p/a-0"), ("p/a-1", "p/a-2")]
    assert a["divergence_step"] >= 0 and made.overview.head()["n_trajectories"] == 7
    direct = made.sub_tasks.where("parent_task = 'a'").orderBy("phase").collect()
    assert [s["task"] for s in a["sub_tasks"] or []] == [s["sub_task_id"] for s in direct] and made.overview.head()["n_decomposed"] == made.sub_tasks.count()
    assert all(s["kind"] == "decomposed" and s["priority"] == pytest.approx(s["gap"] * (1 - s["consistency"])) for s in a["sub_tasks"] or [])
    log.export_json(str(tmp_path / "json"))
    assert sorted(r["task"] for r in spark.read.json(str(tmp_path / "json")).collect()) == ["a", "b", "c", "d"]
    pool = cycle.contribute(cycle.contribute(None, table, "x"), table.where("score > 0.5"), "y")
    doc = cycle.document(cycle.attach_cross_agent_pairs(made, pool))
    assert [t["task"] for t in doc["curriculum"]] == ["a", "d"] and doc["n_recoverable"] == 2 and doc["cross_agent_pairs"]
    assert "  1. a  gap 0.500" in cycle.plan_text(made)
    with pytest.raises(ValueError):
        cycle.document(made, most=1)


def test_simulated_gain_and_sub_tasks(spark, table):
    known = spark.createDataFrame([(0.3, 0.2, 0.4)], "mean double, ci_low double, ci_high double")
    made = cycle.run_cycle(table, simulated=known)
    assert {(r["predicted_gain"], r["gain_low"], r["gain_high"]) for r in made.plan.collect()} == {(0.3, 0.2, 0.4)}
    subs = spark.createDataFrame(
        [("a", "a::phase-1", 1, 2, -1, "Do it", 0.5, 0.5, 0.25, 0.25, "recoverable"), ("a", "a::phase-0", 0, 0, 2, "Begin", 0.5, 0.0, 0.0, 0.0, "stuck"), ("zz", "zz::phase-0", 0, 0, 2, "Else", 0.5, 0.0, 0.0, 0.0, "stuck")],
        "parent_task string, sub_task_id string, phase int, entry_step int, exit_step int, instruction string, reward_delta double, q_star double, q_bar double, gap double, kind string",
    )
    got = {r["task"]: r["sub_tasks"] for r in cycle.attach_sub_tasks(made.plan, subs).collect()}
    assert got["d"] is None and [(s["task"], s["consistency"], s["priority"]) for s in got["a"]] == [("a::phase-0", 0.0, 0.0), ("a::phase-1", 0.5, 0.125)]
    assert got["a"][1]["recommendation"] == "Do it (steps 2 to -1, worth 0.500)."


def test_trainers(spark, table, runs, tmp_path):
    plan = cycle.run_cycle(table, runs).plan
    scores = lambda name: {r["task"]: r["score"] for r in trainers.trainer(name, "base").train(plan, str(tmp_path / name)).collect()}
    assert scores("noop") == {"a": 0.99, "d": 0.99} and scores("axolotl") == {"a": 1.0}
    assert scores("simulated") == pytest.approx({r["task"]: r["score"] for r in curriculum.simulated_training(plan).collect()})
    for name in ("noop", "simulated", "axolotl"):
        assert spark.read.json(str(tmp_path / name / "examples")).count() == 2
    assert "base_model: base" in (tmp_path / "axolotl" / "train.yaml").read_text()
    with pytest.raises(ValueError):
        trainers.trainer("other")


def test_command_line(spark, tmp_path, capsys):
    for i, (task, score, kind) in enumerate([("t1", 1.0, "good"), ("t1", 0.0, "bad"), ("t2", 0.0, "bad"), ("t3", 1.0, "good")]):
        d = tmp_path / "job" / f"trial-{i}"
        traj = {"agent": {"name": "x"}, "steps": [{"tool_calls": [{"function_name": t}]} for t in TOOLS[kind]]}
        for path, text in {"result.json": json.dumps({"task_name": task}), "verifier/reward.txt": str(score), "config.json": json.dumps({"task": {"path": f"tasks/{task}"}}), "agent/trajectory.json": json.dumps(traj)}.items():
            (d / path).parent.mkdir(parents=True, exist_ok=True)
            (d / path).write_text(text)
    plan = tmp_path / "plan.json"
    assert main(["engine", str(tmp_path / "job"), "--agent", "x", "--cycle", "2", "--enable-recursion", "-o", str(plan)]) == 0
    doc = json.loads(plan.read_text())
    assert doc["cycle"] == 2 and doc["recursive"] and [t["task"] for t in doc["curriculum"]] == ["t1"] and len(doc["curriculum"][0]["training_pairs"]) == 1
    assert main(["train", "--curriculum", str(plan), "--trainer", "simulated", "-o", str(tmp_path / "out")]) == 0
    assert "t1: 1.000" in capsys.readouterr().out and spark.read.json(str(tmp_path / "out" / "examples")).count() == 1
    rows = tmp_path / "runs.jsonl"
    rows.write_text("\n".join(json.dumps({"run_id": "r", "model": "m", "task": t, "score": s, "episode": i}) for t in "ab" for i, s in enumerate((0.2, 0.9, 1.0))))
    assert main(["sim", str(rows), "--replicates", "50", "--rounds", "5", "-o", str(tmp_path / "sim.json")]) == 0
    assert set(json.loads((tmp_path / "sim.json").read_text())) == {"gain", "rounds"}
    assert main(["report", str(rows)]) == 0 and "pass_at_1" in capsys.readouterr().out
    assert main(["--help"]) == 0 and main(["nothing"]) == 1 and main([]) == 1 and main(["train", "--curriculum", str(tmp_path / "none.json")]) == 1
