"""Golden values and properties of the episode operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from episodeframe.frame import Episodes
from episodeframe.functions import special
from episodeframe.operators import compare, failure, inference, metrics, pool, retrieval, taxonomy, trajectory, windows


def eps(spark, scores: dict, success=lambda s: s >= 0.99):
    rows = [{"run_id": "r0", "model": "A", "task": t, "episode": i, "score": float(s), "success": bool(success(s))} for t, ss in scores.items() for i, s in enumerate(ss)]
    return Episodes.of(spark, rows).df


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "score double")


@pytest.mark.parametrize(("xs", "want"), [(range(1, 9), 4.5), (range(10), 4.5), ([1] * 4 + [10] * 4, 5.5), ([7] * 10, 7), ([42], 42), ([], None)])
def test_iqm(spark, xs, want):
    assert metrics.iqm(values(spark, xs)).head()[0] == want


def test_pass_metrics(spark):
    df = eps(spark, {"A": [1, 1, 1, 1], "B": [1, 1, 0, 0]})
    r = {x["k"]: x for x in metrics.pass_curve(df, (1, 2)).collect()}
    assert r[1]["pass_at_k"] == 0.75 and r[2]["pass_at_k"] == pytest.approx((1 + 5 / 6) / 2)
    assert metrics.pass_curve(eps(spark, {"A": [1]}), (2,)).head()["pass_at_k"] == 1
    assert metrics.pass_curve(eps(spark, {"A": [0]}), (2,)).head()["pass_at_k"] == 0
    bad = spark.createDataFrame([("t", 2)] * 4, "task string, success int")
    assert math.isnan(metrics.pass_curve(bad, (1,)).head()["pass_at_k"])
    decay = metrics.reliability_decay(eps(spark, {"t1": [1, 1, 0, 0], "t2": [1, 1, 1, 0]}), (1, 2, 4)).head()
    assert decay["slope"] <= 0 and decay["total_drop"] >= 0


def test_summarize_matches_numpy(spark):
    rng = np.random.default_rng(0)
    xs = rng.random(101)
    r = metrics.summarize(eps(spark, {"t": xs}), ks=(1,)).head()
    q1, q3, v = np.quantile(xs, [0.25, 0.75, 0.1])
    assert r["mean"] == pytest.approx(xs.mean()) and r["std"] == pytest.approx(xs.std(ddof=1)) and r["median"] == pytest.approx(np.median(xs))
    assert r["iqm"] == pytest.approx(xs[(xs >= q1) & (xs <= q3)].mean()) and r["cvar_a"] == pytest.approx(xs[xs <= v].mean())


def test_null_keys_are_no_group(spark):
    df = spark.createDataFrame([("a", 1.0, True), (None, 0.0, False)], "model string, score double, success boolean")
    assert [r["model"] for r in metrics.iqm(df, ["model"]).collect()] == ["a"]


def test_taxonomy(spark):
    df = eps(spark, {"s": [1, 1, 1], "h": [0.5, 0.5], "r": [0, 1, 1], "q": [0, 0, 1], "z": [0, 0, 0], "o": [0.7]})
    got = {r["task"]: r for r in taxonomy.task_profiles(df).collect()}
    assert [got[t]["kind"] for t in "shrqzo"] == ["solid", "solid", "recoverable", "recoverable", "stuck", "solid"]
    assert got["r"]["gap"] == pytest.approx(1 / 3) and got["q"]["consistency"] == pytest.approx(1 / 3) and got["z"]["consistency"] == 0
    assert (got["r"]["n_reinforce"], got["r"]["n_contrast"], got["z"]["n_reinforce"], got["z"]["n_contrast"]) == (2, 1, 0, 0)
    rows = {(r["task"], r["attempt"]): r["reinforce"] for r in taxonomy.attempts(df).collect()}
    assert [rows["r", i] for i in range(3)] == [False, True, True] and rows["z", 0] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.8, 1.0]), min_size=1, max_size=12))
def test_entropy_against_numpy(spark, xs):
    got = taxonomy.task_profiles(eps(spark, {"t": xs})).head()["outcome_entropy"]
    n, _ = np.histogram(xs, bins=5, range=(min(xs), max(xs))) if min(xs) < max(xs) else ([len(xs)], 0)
    p = np.array([x for x in n if x]) / len(xs)
    assert got == pytest.approx(0.0 if len(xs) < 2 else float(-(p * np.log(p)).sum()), abs=1e-9)


def test_failures(spark):
    rows = [("easy", False, "timeout")] * 2 + [("hard", False, "crash"), ("hard", True, None), ("easy", True, None), ("hard", False, None)]
    df = spark.createDataFrame(rows, "s_difficulty string, success boolean, failure_mode string")
    got = {(r["s_difficulty"], r["failure_mode"]): r["share_of_failures"] for r in failure.failure_distribution(df, ["s_difficulty"]).collect()}
    assert got == {("easy", "timeout"): 1.0, ("hard", "crash"): 0.5, ("hard", "unlabeled"): 0.5}
    crit = spark.createDataFrame([({"a": True, "b": False},), ({"a": False},), ({},), (None,)], "criteria map<string,boolean>")
    assert [(r["criterion"], r["failure_rate"]) for r in failure.top_failing_criteria(crit, 2).collect()] == [("b", 1.0), ("a", 0.5)]
    with pytest.raises(ValueError):
        failure.failure_distribution(df, ["nope"])


def test_windows(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double")
    assert [round(r["p_adjusted"], 6) for r in windows.adjust_pvalues(p).orderBy("i").collect()] == [0.02, 0.04, 0.04, 0.02]
    assert [round(r["p_adjusted"], 6) for r in windows.adjust_pvalues(p, method="holm").orderBy("i").collect()] == [0.03, 0.06, 0.06, 0.02]
    a = [r["advantage"] for r in windows.grpo_advantages(spark.createDataFrame([(0, "a", 0.0), (1, "a", 1.0), (2, "b", 10.0), (3, "b", 20.0)], "i int, task string, score double")).orderBy("i").collect()]
    assert a[0] < 0 < a[1] and a[1] == pytest.approx(a[3], abs=1e-6)
    c = windows.confidence_sequence(spark.createDataFrame([(i, float(i % 2)) for i in range(4)], "i int, score double"), ["i"]).orderBy("i").collect()
    assert [r["running_mean"] for r in c] == pytest.approx([0, 0.5, 1 / 3, 0.5])


def two(spark, a, b):
    return spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "model string, score double")


def sides():
    return F.col("model") == "a", F.col("model") == "b"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=7), st.lists(st.integers(0, 5), min_size=1, max_size=7))
def test_distances_against_pairs(spark, a, b):
    r = compare.distances(two(spark, a, b), *sides()).head()
    assert r["prob_improvement"] == pytest.approx(np.mean([1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b]))
    grid = np.arange(0, 6)
    fa, fb = (np.array([np.mean(np.array(s) <= g) for g in grid]) for s in (a, b))
    assert r["ks_d"] == pytest.approx(np.abs(fa - fb).max()) and r["wasserstein"] == pytest.approx(np.abs(fa - fb).sum())


def test_compare_all(spark):
    r = compare.compare_distributions(two(spark, [1, 2, 3], [1, 2, 3]), *sides())
    assert r["wasserstein"] == 0 and r["ks_d"] == 0 and r["prob_improvement"] == 0.5 and r["effect_size"] == 0 and r["fsd_a_over_b"] and r["ks_p"] == pytest.approx(1)
    r = compare.compare_distributions(two(spark, [5, 6, 7, 8], [1, 2, 3, 4]), *sides())
    assert r["fsd_a_over_b"] and not r["fsd_b_over_a"] and r["mwu_p"] == pytest.approx(2 / 70) and r["ks_p"] == pytest.approx(2 / 70)


def test_special_functions():
    for a, b, x in ((1, 5, 0.3), (4, 1, 0.7)):
        assert special.betainc(a, b, x) == pytest.approx(1 - (1 - x) ** b if a == 1 else x**a)
    assert special.beta_ppf(0.3, 1, 4) == pytest.approx(1 - 0.7**0.25)
    assert special.t_sf(1.0, 1) == pytest.approx(0.25)
    n, m = 3, 4
    ds = []
    for pick in itertools.combinations(range(n + m), n):
        a = np.isin(np.arange(n + m), pick)
        ds.append(np.abs(np.cumsum(a) / n - np.cumsum(~a) / m).max())
    for d in sorted(set(np.round(ds, 9))):
        assert special.ks_pvalue(d, n, m) == pytest.approx(np.mean(np.array(ds) >= d - 1e-9))
    assert sum(special._mwu_counts(3, 4)) == math.comb(7, 3)
    lo, hi = special.binomial_interval(0, 10)
    assert lo == 0 and hi == pytest.approx(1 - 0.025 ** (1 / 10))
    assert compare.required_n(0) == 2**31 - 1 and compare.required_n(compare.min_detectable_effect(50, 50)) in (50, 51)
    assert math.isnan(compare.length_bias_test(None, 2)["p"])


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    df = eps(spark, {f"t{i}": rng.random(20) for i in range(5)})
    one, two_ = (inference.bootstrap_ci(df.repartition(n), "mean", ["task"], reps=400, seed=3).head() for n in (1, 7))
    assert list(one) == pytest.approx(list(two_)) and one["lo"] < one["point"] < one["hi"]
    r = inference.bootstrap_function_ci(df.select("task", "score"), lambda d: d["score"].mean(), ["task"], reps=100)
    assert r["width"] == pytest.approx(one["width"], rel=0.4)


def test_ppi(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, 0.8), (None, 0.5), (None, 0.9)], "gold double, judge double")
    r = inference.ppi_mean(df).head()
    g, j, u = np.array([1, 0, 1.0]), np.array([0.9, 0.1, 0.8]), np.array([0.5, 0.9])
    lam = min(1, np.cov(g, j)[0, 1] / (j.var(ddof=1) + 3 / 2 * u.var(ddof=1)))
    assert r["lam"] == pytest.approx(lam) and r["point"] == pytest.approx(g.mean() + lam * (u.mean() - j.mean()))


def test_2pl_and_ranking(spark):
    rng = np.random.default_rng(0)
    theta, a, b = rng.normal(size=300), rng.uniform(0.7, 2, 20), rng.uniform(-2, 2, 20)
    x = rng.random((300, 20)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))
    cells = spark.createDataFrame([(f"m{i:03}", f"t{j:02}", int(x[i, j])) for i in range(300) for j in range(20)], "model string, task string, x int")
    people, items = inference.fit_2pl(cells)
    assert np.corrcoef(people["ability"].rank(), np.argsort(np.argsort(theta)))[0, 1] > 0.8 and np.corrcoef(items["b"], b)[0, 1] > 0.8
    wins = compare.win_counts(spark.createDataFrame([("x", "y", 1.0)] * 8 + [("y", "x", 1.0)] * 2 + [("y", "z", 1.0)] * 5, "a string, b string, s double"))
    r = inference.bradley_terry(wins, ci=0.9, n_boot=50)
    assert r["ranking"] == ["x", "y", "z"] and r["probs"].sum() == pytest.approx(1)
    best = inference.select_items(spark.createDataFrame([("0", 0.1, 0.0), ("1", 2.0, 0.0), ("2", 0.1, 0.0), ("3", 1.5, 0.0)], "task string, a double, b double"), 2, [0.0])
    assert {r["task"] for r in best.collect()} == {"1", "3"}


def records(spark, rows):
    return spark.createDataFrame([(a, a, t, float(s), c, None, s >= 1, None, 0, i) for i, (a, t, s, c) in enumerate(rows)], "agent_name string, model_name string, task string, score double, checkpoint_scores map<string,double>, trajectory_ref string, success boolean, failure_mode string, sub_task_depth int, ord bigint")


def test_pool(spark):
    df = records(spark, [("A", "e1", 1.0, {"ck0": 1.0, "ck1": 1.0}), ("B", "e1", 0.0, {"ck0": 0.0, "ck1": 0.0}), ("A", "e2", 1.0, {"ck0": 1.0}), ("B", "e2", 0.9, {"ck0": 0.9})])
    pairs = pool.cross_agent_pairs(df).collect()
    assert [p["task"] for p in pairs] == ["e1"] and pairs[0]["disagreement_checkpoints"] == ["ck0", "ck1"] and "A succeeds on ck0, ck1 where B fails" == pairs[0]["attribution"]
    tied = records(spark, [("A", "t", 1.0, {}), ("B", "t", 1.0, {})])
    r = pool.aggregate_by_task(tied).head()
    assert r["best_agent"] == "A" and r["worst_agent"] == "A"
    ivw = records(spark, [("A", "t1", s, {}) for s in (0.81, 0.80, 0.79)] + [("B", "t1", s, {}) for s in (0.95, 0.50, 0.65)])
    assert pool.aggregate_by_task_ivw(ivw).head()["mean_score"] > 0.75
    xs = [0.80, 0.81, 0.82, 0.79, 0.05]
    assert pool.aggregate_by_task_robust(records(spark, [("A", "t", x, {}) for x in xs])).head()["mean_score"] > np.mean(xs)


def test_consensus(spark):
    rows = [("p", "write", 3, 7, "a", 0.5, ""), ("p", "write", 4, 8, "b", 0.5, ""), ("p", "write", 9, 9, "c", 0.5, "")]
    votes = spark.createDataFrame(rows, "parent_task string, phase_tag string, entry_step int, exit_step int, agent_name string, confidence double, source string")
    got = pool.consensus(votes).collect()
    assert len(got) == 1 and got[0]["n_votes"] == 2 and got[0]["agents"] == ["a", "b"]
    wide = spark.createDataFrame([("p", "w", 10, 10, "a", 0.9, ""), ("p", "w", 4, 4, "b", 0.1, "")], votes.schema)
    assert pool.consensus(wide, tolerance=10).head()["entry_step"] > 7


def seqs(spark, rows):
    return spark.createDataFrame([(f"t{i}", "task/x", float(s), list(q)) for i, (s, q) in enumerate(rows)], "trial_id string, task_path string, score double, tool_sequence array<string>")


def test_trajectory_features(spark):
    f = [r for r in trajectory.features(seqs(spark, [(1, []), (1, ["read_file"] * 3 + ["write_file"]), (1, ["read_file", "list_directory", "search_tool"]), (1, ["search_tool"] * 3 + ["write_file"]), (1, ["write_file", "read_file"])])).orderBy("trial_id").collect()]
    assert f[0]["n_tool_calls"] == 0 and f[1]["first_write_pos"] == 3 and f[2]["first_write_pos"] == 3 and f[3]["search_ratio"] == 0.75 and f[4]["write_before_read"] and not f[1]["write_before_read"]
    p = trajectory.features(seqs(spark, [(1, ["read_file"] * 5 + ["write_file"] * 5)]), prefix=5).head()
    assert p["is_prefix"] and p["prefix_len"] == 5 and p["n_writes"] == 0


def test_predictor_and_retrieval(spark):
    good, bad = ["write_file", "run_shell_command", "run_shell_command"], ["search_tool"] * 4
    df = seqs(spark, [(1.0, good)] * 3 + [(0.0, bad)] * 3)
    rows = trajectory.features(df)
    p = trajectory.fit_predictor(rows)
    got = {r["trial_id"]: r for r in trajectory.check(rows, p).collect()}
    assert got["t0"]["prediction"] == "high" and got["t3"]["prediction"] == "low" and got["t3"]["warning"] and got["t0"]["warning"] is None
    assert trajectory.loo_accuracy(rows) == 1.0
    top = trajectory.retrieve(df, "some task x", good, 2).collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["score"] == 1.0 and top[0]["is_recoverable_high"]
    q = seqs(spark, [(0.0, good)]).withColumn("query_id", F.lit("q")).drop("trial_id")
    sims = retrieval.most_similar(q, df, 1).collect()
    assert {r["outcome"] for r in sims} == {"high"} and sims[0]["similarity"] == pytest.approx(1)


def test_frame(spark):
    e = Episodes.of(spark, [{"run_id": "r", "model": "A", "task": "t", "score": float("nan"), "success": False}, {"run_id": "r", "model": "A", "task": "t", "score": 0.9, "success": True, "strata": {"k": "v"}}])
    assert e.slice(k=None).df.count() == 1 and e.slice(k="v").df.count() == 1
    assert e.query(score_max=0.5).df.count() == 1 and e.query(k=["v", "w"]).df.count() == 1
    assert e.filter(lambda r: r["success"]).df.count() == 1 and e.promote().strata_columns == ["s_k"]
    assert [r["episode"] for r in e.numbered().df.orderBy("ord").collect()] == [0, 1]
    with pytest.raises(ValueError):
        Episodes.of(spark, [{"nope": 1}])


def test_numbered_rows_stay_dealt(spark):
    """Rows of many groups lie in all shuffle partitions, though they are few bytes, and count from 0 in each group."""
    rows = spark.range(4000).selectExpr("concat('r', id % 40) as run_id", "'m' as model", "concat('t', id % 8) as task", "4000 - id as ord")
    found = Episodes(rows).numbered().df
    # Spark merges partitions that it made itself, and leaves those that were asked for by number.
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    groups = {}
    for r in found.collect():
        groups.setdefault((r["run_id"], r["task"]), []).append((r["ord"], r["episode"]))
    assert len(groups) == 40 and all([e for _, e in sorted(g)] == list(range(100)) for g in groups.values())
