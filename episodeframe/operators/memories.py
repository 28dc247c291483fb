"""Texts about remembered trajectories, and counts of a memory: columns and one small report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodeframe.operators import trajectory

#: Tools that a recommendation names.
NAMED_TOOLS = ("write_file", "run_shell_command", "exec_command", "edit", "read_file")
OPENINGS = {
    "before_task": "Runs of similar tasks that went well, before you begin.",
    "mid_task": "Runs that resemble what you have done so far.",
    "recovery": "This run looks like those that end low; these ones did not.",
}


def retrieve_for_task(records: DataFrame, description: str, k: int = 3) -> DataFrame:
    """High runs for a task that was never tried."""
    return trajectory.retrieve(records, description, None, k, "high")


def retrieve_for_sub_task(records: DataFrame, description: str, sequence: list[str], k: int = 3) -> DataFrame:
    """High runs for a sub-task: its description and the tools used inside its window."""
    return trajectory.retrieve(records, description, sequence, k, "high")


def first_action() -> Column:
    """Tool at ``first_write_pos``; null where nothing was written or executed."""
    return F.get("tool_sequence", F.col("first_write_pos").cast("int"))


def summary() -> Column:
    """One line about a run (columns of ``features`` and ``recoverable_highs``)."""
    mark = F.when(F.col("is_recoverable_high"), "recoverable high, ").otherwise("")
    return F.format_string("%s%s: %d steps, begins with %s, executes %d times, score %.2f", mark, "outcome_class", F.col("n_steps").cast("int"), F.coalesce(first_action(), F.lit("none")), F.col("n_exec").cast("int"), "score")


def insight() -> Column:
    """What the structure of a run tells."""
    place = F.col("first_write_pos").cast("int") + 1
    ran = F.when(F.col("n_exec") > 0, F.format_string("code ran %d times in %d steps", F.col("n_exec").cast("int"), F.col("n_steps").cast("int"))).otherwise("no code was ever run")
    return F.when(first_action().isNull(), "Only looked around: nothing was written or executed.").otherwise(F.format_string("Acted first at step %d (%s); %s.", place, first_action(), ran))


def recommendation(found: DataFrame) -> DataFrame:
    """One row, ``recommendation``: what high runs among ``found`` share, and how low ones differ."""
    high, low = F.col("outcome_class") == "high", F.col("outcome_class") == "low"
    named = F.filter("tool_sequence", lambda t: t.isin(*NAMED_TOOLS))
    g = found.agg(
        F.avg(F.when(high, F.col("first_write_pos"))).alias("high_first"), F.avg(F.when(high, F.col("n_exec"))).alias("high_exec"), F.avg(F.when(low, F.col("first_write_pos"))).alias("low_first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(high, F.array_distinct(named)))))).alias("tools"),
    )
    tools = F.when(F.size("tools") > 0, F.array_join("tools", ", ")).otherwise("tools that edit and execute")
    of_high = F.when(F.col("high_first").isNotNull(), F.format_string("High runs act early (first at index %.1f on average), run code %.1f times and use %s.", "high_first", "high_exec", tools))
    of_low = F.when(F.col("low_first").isNotNull(), F.format_string("Low runs waited until index %.1f.", "low_first"))
    none = F.lit("These runs show no contrast; test your code often.")
    text = F.when(of_high.isNull() & of_low.isNull(), none).otherwise(F.concat_ws(" ", of_high, of_low))
    return g.select(text.alias("recommendation"))


def prompt(found: DataFrame, context: str = "before_task", most: int = 100) -> str:
    """Text for an agent from retrieved runs (a top-k table, ``most`` rows at most)."""
    rows = found.select("rank", "task_path", "score", "similarity", "outcome_class", F.array_join("tool_sequence", " -> ").alias("tools"), summary().alias("summary"), insight().alias("insight")).orderBy("rank").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a prompt holds at most {most} runs")
    lines = [f"{len(rows)} remembered runs. {OPENINGS.get(context, OPENINGS['before_task'])}"]
    for r in rows:
        tools = r["tools"] if len(r["tools"]) <= 80 else r["tools"][:77] + "..."
        lines += ["", f"#{r['rank']} {r['task_path']} (similarity {r['similarity']:.2f})", f"  {r['summary']}", f"  tools: {tools}", f"  {r['insight']}"]
    return "\n".join([*lines, "", recommendation(found).head()[0]])


def stats(records: DataFrame) -> DataFrame:
    """One row: n_entries, n_high, n_low, n_recoverable_high, vocab_size (different tools)."""
    marked = trajectory.recoverable_highs(records)
    n = lambda cond: F.count_if(cond)
    counts = marked.agg(F.count(F.lit(1)).alias("n_entries"), n(F.col("outcome_class") == "high").alias("n_high"), n(F.col("outcome_class") == "low").alias("n_low"), n("is_recoverable_high").alias("n_recoverable_high"))
    tools = records.select(F.explode("tool_sequence").alias("tool")).agg(F.countDistinct("tool").alias("vocab_size"))
    return counts.crossJoin(tools)  # one row by one row
