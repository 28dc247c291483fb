"""Registered queries read all rows of their tables: compared with plain Python over small tables."""

from collections import defaultdict
from datetime import datetime, timedelta
from statistics import fmean, variance

import numpy as np
import pytest

from episodeframe import catalog, catalog_plans  # noqa: F401  (the second registers more queries)
from episodeframe.operators import pool

TOOLS = {"view": "read_file", "click": "list_directory", "signup": "search_tool", "purchase": "write_file", "error": "run_shell_command"}


def events(spark, path):
    """(event_id, user_id, event_type) of 20 users, all last digits among them."""
    rows = [(i, i * 7 % 20, sorted(TOOLS)[i * i % 11 % 5]) for i in range(300)]
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(i, at + timedelta(seconds=i), u, t, 0.0, "{}") for i, u, t in rows], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return rows


def brute_consensus(rows, tolerance=4):
    groups = defaultdict(list)
    for i, u, t in rows:
        groups[f"task-{u % 5}", TOOLS[t]].append(i % 30)
    out = []
    for (task, tag), entries in groups.items():
        clusters = []
        for e in sorted(entries):
            if clusters and e - clusters[-1][0] <= tolerance:
                clusters[-1].append(e)
            else:
                clusters.append([e])
        out += [(task, tag, c[(len(c) - 1) // 2], c[(len(c) - 1) // 2] + 3, len(c), len(c) / 2, 0.5) for c in clusters if len(c) >= 2]
    return sorted(out)


def test_consensus_and_variants_of_all_events(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = catalog.QUERIES["consensus"](spark, str(tmp_path))
    assert got.columns == ["parent_task", "phase_tag", "entry_step", "exit_step", "n_votes", "total_confidence", "mean_confidence"]
    assert sorted(map(tuple, got.collect())) == brute_consensus(rows)
    assert {r["parent_task"] for r in got.collect()} == {f"task-{k}" for k in range(5)}
    got = catalog.QUERIES["boundary_variants"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f"trial_{u}", TOOLS[t], i % 30, i % 30 + 3 * (i % 3 > 0), 0.5) for i, u, t in rows)


def test_pool_of_all_runs(spark, tmp_path):
    """One episode for each of 7 years, 6 models and 4 tasks; lowest and highest score are not in 1996 or 1997."""
    models, years = [f + s for f in "ANR" for s in "FO"], range(1992, 1999)
    tenths = {(m, y): 0 if y == 1992 else 10 if y == 1998 else 2 + (y + y // 1995 * m) % 7 for m in range(6) for y in years}
    # Keys that end in 2 to 5: the score is ten times the discount.
    rows = [(1000 * y + 10 * m + p, p, 1, 1, 5.0, 100.0, t / 100, 0.0, *models[m], datetime(y, 6, 1)) for (m, y), t in tenths.items() for p in range(2, 6)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, 10) for p in range(2, 6)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    of = {f"agent_{models[m]}": [tenths[m, y] / 10 for y in years] for m in range(6)}
    every = [x for v in of.values() for x in v]
    got = {name: catalog.QUERIES[name](spark, str(tmp_path)).collect() for name in ("pool_agents", "agent_variances", "pool_by_task", "pool_by_task_ivw", "pool_by_task_robust", "weighted_median", "cross_agent_pairs", "pool_weighted_pairs")}

    assert {tuple(r) for r in got["pool_agents"]} == {(a, 4, 28) for a in of}
    spread = {a: variance(v * 4) for a, v in of.items()}
    assert {r["agent_name"]: r["variance"] for r in got["agent_variances"]} == pytest.approx(spread, abs=1e-6)
    ivw = sum(sum(v) / spread[a] for a, v in of.items()) / sum(len(v) / spread[a] for a, v in of.items())
    robust = pool.robust_mean(np.array(every), np.ones(len(every)))[0]
    for name, mean in (("pool_by_task", fmean(every)), ("pool_by_task_ivw", ivw), ("pool_by_task_robust", robust)):
        for r in got[name]:
            assert (r["n_records"], r["min_score"], r["max_score"], r["best_agent"], r["worst_agent"]) == (42, 0.0, 1.0, "agent_AF", "agent_AF"), name
            assert r["mean_score"] == pytest.approx(mean, abs=1e-6), name
    weighed = sorted(t / 10 for (m, y), t in tenths.items() for _ in range(1 + (y + m) % 3))
    assert all(r["weighted_median"] == pytest.approx(weighed[(len(weighed) + 1) // 2 - 1]) for r in got["weighted_median"])
    assert all(r["gap"] == 1.0 for name in ("cross_agent_pairs", "pool_weighted_pairs") for r in got[name])
    assert all(len({r["task"] for r in v}) == len(v) == 4 for name, v in got.items() if name not in ("pool_agents", "agent_variances"))
