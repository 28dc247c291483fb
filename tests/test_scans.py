"""Quantiles, scans and profiles over many partitions, against plain windows and aggregates."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodeframe.operators import metrics, pool, quantiles, scans, taxonomy, windows

R = scans.Running


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(None if r.random() < 0.05 else r.choice("aaaaaabc"), i, r.choice([None, 1.0, 2.0, r.random() * 5])) for i in range(700)]
    return spark.createDataFrame(data, "k string, o bigint, v double").repartition(3).cache()


def near(frame):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in frame.collect()), key=str)


@pytest.fixture
def spread(spark):
    """Small partitions stay apart, so that keys do lie on several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("by", [["k"], []])
def test_running_equals_windows(rows, spread, by):
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("o")
    first, here, last = Window.unboundedPreceding, 0, Window.unboundedFollowing
    want = rows.select(
        "*", F.sum("v").over(w.rowsBetween(first, here)), F.sum("v").over(w.rowsBetween(here, last)), F.count(F.lit(1)).over(w.rowsBetween(first, here)), F.count("v").over(w.rowsBetween(first, -1)),
        F.min("v").over(w.rowsBetween(here, last)), F.max("v").over(w.rowsBetween(first, -1)), F.lag("v").over(w), F.lead("v").over(w),
    )
    v = F.col("v")
    got = scans.running(rows, ["o"], by, {"a": R("sum", v), "b": R("sum", v, True), "c": R("count"), "d": R("count", v, exclusive=True), "e": R("min", v, True), "f": R("max", v, exclusive=True), "g": R("last", v, exclusive=True), "h": R("last", v, True, True)})
    assert near(got) == near(want)


def test_row_numbers(rows, spread):
    want = rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("v"), "o")))
    got = scans.row_numbers(rows, [F.desc("v"), "o"], "n")
    assert near(got) == near(want)
    assert scans.row_numbers(rows.limit(0), ["o"]).collect() == []


@pytest.mark.parametrize("by", [["k"], []])
def test_quantiles_equal_percentile(spark, by):
    df = spark.range(30_000).select(F.when(F.col("id") % 7 < 4, "a").when(F.col("id") % 997 == 0, "c").otherwise("b").alias("k"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3) * F.rand(5)).alias("score")).cache()
    levels = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.1, "e": 0.975, "f": 1.0}
    got = quantiles.quantiles(metrics.distribution(df, by), by, levels)
    want = df.groupBy(*by).agg(*(F.percentile("score", F.lit(p)).alias(name) for name, p in levels.items()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert " percentile(" not in plan and "collect_" not in plan


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, score double")
    got = {r["k"]: (r["lo"], r["m"]) for r in quantiles.quantiles(metrics.distribution(df, ["k"]), ["k"], {"lo": 0.25, "m": 0.5}).collect()}
    assert got == {"a": (1.0, 1.0), "b": (2.5, 3.0)}
    assert metrics.value_at_risk(df.limit(0)).collect()[0]["var"] is None


@pytest.mark.parametrize("method", ["bh", "holm"])
@pytest.mark.parametrize("by", [["k"], []])
def test_adjusted_pvalues_equal_sorted_ones(rows, spread, method, by):
    df = rows.withColumn("p", F.round(F.col("v") / 5, 2))
    want = []
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"] if by else 0, []).append(r)
    for members in groups.values():
        ordered = sorted((r for r in members if r["p"] is not None), key=lambda r: r["p"])
        n, out = len(ordered), [0.0] * len(ordered)
        if method == "bh":
            low = 1.0
            for i in range(n - 1, -1, -1):
                low = out[i] = min(low, n / (i + 1) * ordered[i]["p"])
        else:
            high = 0.0
            for i in range(n):
                high = max(high, (n - i) * ordered[i]["p"])
                out[i] = min(1.0, high)
        want += [(r["o"], round(x, 9)) for r, x in zip(ordered, out, strict=True)] + [(r["o"], None) for r in members if r["p"] is None]
    got = windows.adjust_pvalues(df, "p", method, by)
    assert got.columns == [*df.columns, "p_adjusted"]
    assert sorted(map(str, ((r["o"], None if r["p_adjusted"] is None else round(r["p_adjusted"], 9)) for r in got.collect()))) == sorted(map(str, want))


def test_last_stage_of_a_keyless_scan_has_many_tasks(rows, spread):
    got = windows.confidence_sequence(rows.fillna({"v": 0.5}), ["o"], value="v", hi=5.0)
    got.collect()
    assert got.rdd.getNumPartitions() > 1
    w = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    assert near(got.select("o", "t", "running_mean")) == near(rows.fillna({"v": 0.5}).select("o", F.row_number().over(Window.orderBy("o")).alias("t"), F.avg("v").over(w).alias("running_mean")))


def test_weighted_median_and_ranks(rows, spread):
    df = rows.where("k is not null and v is not null").withColumn("w", F.col("o") % 4 + 1.0)
    want = {}
    for r in df.collect():
        want.setdefault(r["k"], []).append((r["v"], r["w"]))
    middle = {}
    for k, pairs in want.items():
        total, run = sum(w for _, w in pairs), 0.0
        for v, w in sorted(pairs):
            run += w
            if run >= total / 2:
                middle[k] = v
                break
    assert {r["k"]: r["weighted_median"] for r in pool.weighted_median(df, "v", "w", ["k"]).collect()} == middle
    ranks = windows.average_ranks(df, "v", ["k"])
    low = F.rank().over(Window.partitionBy("k").orderBy("v"))
    tied = F.count(F.lit(1)).over(Window.partitionBy("k", "v"))
    assert near(ranks.select("o", "avg_rank")) == near(df.select("o", (low + (tied - 1) / 2).alias("avg_rank")))


def test_profiles_hold_no_attempts(rows):
    df = rows.where("v is not null").select(F.lit("m").alias("model"), F.coalesce("k", F.lit("z")).alias("task"), (F.col("v") / 5).alias("score"), F.col("o").alias("ord"), F.when(F.col("o") % 2 == 0, "easy").otherwise("hard").alias("s_difficulty"))
    got = taxonomy.task_profiles(df)
    plan = got._jdf.queryExecution().toString()
    assert "collect_" not in plan and "array" not in plan.lower()
    lists = {r["task"]: r["scores"] for r in taxonomy.with_scores(got, df).collect()}
    hard = {r["task"]: r["s_difficulty"] for r in df.orderBy(F.desc("ord")).collect()}
    for r in got.collect():
        s = lists[r["task"]]
        assert (r["n_attempts"], r["q_star"], r["difficulty"]) == (len(s), max(s), hard[r["task"]])
        assert r["q_bar"] == pytest.approx(sum(s) / len(s)) and r["n_reinforce"] == sum(x >= 0.9 * max(s) for x in s)
    rows_ = {(r["task"], r["attempt"]): r["score"] for r in taxonomy.attempts(df).collect()}
    assert all(rows_[t, i] == x for t, s in lists.items() for i, x in enumerate(s)) and len(rows_) == sum(map(len, lists.values()))
