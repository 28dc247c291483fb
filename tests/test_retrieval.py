"""Top-k retrieval for tables of queries, against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from episodeframe.operators import retrieval

TOOLS = ["read_file", "write_file", "search_tool", "run_shell_command", "edit", "żółw"]


def data():
    r = random.Random(2)
    seq = lambda: [r.choice(TOOLS) for _ in range(r.randint(0, 9))]
    records = [(f"t{i:03}", r.choice([0.0, 0.3, 0.5, 0.8, 1.0]), seq(), f"tasks/Task-{i % 13}", r.choice(["high", "medium", "low"]), i % 5 == 0) for i in range(180)]
    records += [("t003", *records[3][1:]), (None, 1.0, seq(), "x", "high", False), ("n1", None, seq(), "x", "low", False), ("n2", 0.5, None, None, "low", None)]
    queries = [(f"q{i}", r.choice(["solve Task 5", "nothing", "", None, "task task 1 12"]), seq(), r.choice([None, "high"])) for i in range(23)] + [(None, "x", seq(), None)]
    return records, queries


def cosine(a, b):
    a, b = Counter(a or ()), Counter(b or ())
    scale = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return round(sum(n * b[t] for t, n in a.items()) / scale, 12) if scale else 0.0


RECORDS = "trial_id string, score double, tool_sequence array<string>, task_path string, outcome_class string, is_recoverable_high boolean"


@pytest.mark.parametrize("block", [256, 4])
def test_retrieve_many(spark, block):
    records, queries = data()
    want = []
    for q, text, seq, outcome in queries:
        words = list(dict.fromkeys(re.findall("[a-z0-9]+", (text or "").lower())))
        rows = []
        for t, score, tools, path, kind, again in records:
            if q is None or t is None or score is None or (outcome and kind != outcome):
                continue
            c = cosine(seq, tools)
            m = sum(w in (path or "").lower() for w in words) / len(words) if words else 0.0
            rows.append((-round((0.7 * c + 0.3 * m) * (1.3 if again else 1), 12), -score, not again, t, c, m))
        want += [(q, n + 1, x[3], x[4], pytest.approx(x[5]), -x[0]) for n, x in enumerate(sorted(rows)[:4])]
    frame = spark.createDataFrame(records, RECORDS).repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, description string, tool_sequence array<string>, outcome string")
    got = retrieval.retrieve_many(frame, asked, 4, block=block).select("query_id", "rank", "trial_id", "similarity", "task_match", "final_score")
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda w: w[:2])
    assert retrieval.retrieve_many(frame, asked.limit(0)).collect() == [] and retrieval.retrieve_many(frame.limit(0), asked).collect() == []


def test_most_similar(spark):
    records, queries = data()
    want = []
    for q, _, seq, _ in queries:
        for outcome in ("high", "low"):
            rows = sorted((-cosine(seq, tools), s, t) for t, s, tools, *_ in records if q and t and s is not None and tools and (s >= 0.5) == (outcome == "high") and cosine(seq, tools) > 0)
            want += [(q, outcome, n + 1, t, -c) for n, (c, s, t) in enumerate(rows[:3])]
    frame = spark.createDataFrame(records, RECORDS).repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, description string, tool_sequence array<string>, outcome string")
    got = retrieval.most_similar(asked, frame, block=5)
    assert sorted(map(tuple, got.select("query_id", "outcome", "rank", "trial_id", "similarity").collect())) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan
    near = {r["query_id"]: r for r in retrieval.with_similar(asked.where("query_id is not null"), frame).collect()}
    assert len(near) == 23
    for q, outcome, rank, t, _ in want:
        assert near[q][f"similar_{outcome}"][rank - 1]["trial_id"] == t
