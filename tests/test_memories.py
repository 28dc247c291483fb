import pytest
from pyspark.sql import functions as F

from episodeframe.operators import memories, trajectory


@pytest.fixture(scope="module")
def records(spark):
    rows = [("a", "tasks/x", 1.0, ["read_file", "write_file", "run_shell_command"]), ("b", "tasks/x", 0.0, ["search_tool"] * 6), ("c", "tasks/y", 0.9, ["write_file"]), ("d", "tasks/y", 0.5, [])]
    return trajectory.features(spark.createDataFrame(rows, "trial_id string, task_path string, score double, tool_sequence array<string>")).cache()


def test_texts(records):
    rows = {r["trial_id"]: r for r in trajectory.recoverable_highs(records).select("trial_id", memories.summary().alias("s"), memories.insight().alias("i")).collect()}
    assert rows["a"]["s"].startswith("recoverable high, high: ") and "begins with write_file" in rows["a"]["s"] and rows["a"]["i"].startswith("Acted first at step 2 (write_file); code ran ")
    assert "begins with none" in rows["b"]["s"] and rows["b"]["i"].startswith("Only looked") and rows["d"]["i"].startswith("Only looked")
    assert rows["c"]["i"].endswith("no code was ever run.")


def test_retrieval_and_prompt(records):
    found = memories.retrieve_for_task(records, "x", 3)
    assert [r["trial_id"] for r in found.orderBy("rank").collect()] == ["a", "c"]
    assert memories.retrieve_for_sub_task(records, "phase 1", ["write_file"], 1).head()["trial_id"] == "c"
    text = memories.prompt(found, "recovery")
    assert text.startswith("2 remembered runs. This run looks") and "#1 tasks/x" in text and "read_file, run_shell_command, write_file" in text.splitlines()[-1]
    both = memories.recommendation(trajectory.recoverable_highs(records)).head()[0]
    assert "High runs act early" in both and "Low runs waited" in both
    assert memories.recommendation(trajectory.recoverable_highs(records).where(F.lit(False))).head()[0].startswith("These runs show no contrast")
    with pytest.raises(ValueError):
        memories.prompt(found, most=1)


def test_stats(records):
    assert memories.stats(records).head().asDict() == {"n_entries": 4, "n_high": 2, "n_low": 1, "n_recoverable_high": 1, "vocab_size": 4}
    assert memories.stats(records.where("false")).head()["n_entries"] == 0
