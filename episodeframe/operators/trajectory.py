"""Tool sequences of trajectories: features, outcome prediction, similarity, retrieval."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.functions.columns import sigmoid
from episodeframe.operators import retrieval

# Names of tools and the canonical ones they stand for.
ALIASES = {
    "write": "write_file",
    "write_file": "write_file",
    "write_todos": "write_todos",
    "create_file": "write_file",
    "edit_file": "write_file",
    "apply_edit": "write_file",
    "run_shell_command": "run_shell_command",
    "exec_command": "exec_command",
    "bash": "run_shell_command",
    "bash_command": "run_shell_command",
    "run_command": "run_shell_command",
    "execute_command": "run_shell_command",
    "execute": "exec_command",
    "read_file": "read_file",
    "read": "read_file",
    "view": "read_file",
    "list_directory": "list_directory",
    "list_files": "list_directory",
    "list_dir": "list_directory",
}
WRITES = ("write_file", "write_todos", "run_shell_command", "exec_command")
EXECS = ("run_shell_command", "exec_command")
READS = ("read_file", "list_directory")
FEATURES = ("log1p_first_write_pos", "log1p_first_exec_pos", "n_exec", "n_search", "search_ratio", "n_writes", "n_reads", "write_before_read", "tool_diversity", "n_steps")


def normalize(name: Column) -> Column:
    """Canonical tool: alias, alias in lower case, anything with "search", else lower case."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    key = F.trim(name)
    low = F.lower(key)
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(F.coalesce(table[key], table[low], F.when(low.contains("search"), "search_tool"), low))


def tool_sequence(steps: str = "steps") -> Column:
    """Canonical tools of all steps' calls, in order; nameless calls are skipped."""
    raw = F.flatten(F.transform(steps, lambda s: F.transform(F.coalesce(s["tool_calls"], F.array().cast(_CALLS)), lambda c: F.coalesce(F.nullif(c["function_name"], F.lit("")), c["tool_use_name"]))))
    return F.transform(F.filter(raw, lambda n: n.isNotNull() & (n != "")), normalize)


_CALLS = "array<struct<function_name:string,tool_use_name:string,arguments:string,tool_call_id:string>>"


def features(df: DataFrame, sequence: str = "tool_sequence", prefix: Column | int | None = None) -> DataFrame:
    """Adds the features of a sequence or of its first ``prefix`` tools; "never" is the prefix' length."""
    seq = F.col(sequence)
    if prefix is not None:
        n = F.greatest(F.lit(0), F.lit(prefix) if isinstance(prefix, int) else prefix)
        part, is_prefix = F.slice(seq, F.lit(1), n), n < F.size(seq)
    else:
        part, is_prefix = seq, F.lit(False)
    df = df.withColumn("_p", part).withColumn("prefix_len", F.size("_p"))
    size = F.col("prefix_len")
    among = lambda names: (lambda t: t.isin(*names))
    count = lambda names: F.size(F.filter("_p", among(names)))

    def first(names):
        at = F.array_position(F.transform("_p", lambda t: t.isin(*names)), F.lit(True))
        return F.when(at > 0, at - 1).otherwise(size).cast("int")

    df = df.withColumns({"first_write_pos": first(WRITES), "first_exec_pos": first(EXECS), "_first_read": first(READS)})
    return df.withColumns(
        {
            "n_steps": size,
            "n_tool_calls": size,
            "n_reads": count(READS),
            "n_writes": count(WRITES),
            "n_exec": count(EXECS),
            "n_search": count(("search_tool",)),
            "search_ratio": count(("search_tool",)) / F.greatest(size, F.lit(1)),
            "write_before_read": (F.col("first_write_pos") < size) & (F.col("_first_read") < size) & (F.col("first_write_pos") < F.col("_first_read")),
            "tool_diversity": F.size(F.array_distinct("_p")) / F.greatest(size, F.lit(1)),
            "is_prefix": is_prefix,
        }
    ).drop("_p", "_first_read")


def prefix_features(calls: DataFrame, trial: str, order: list[str], tool: str = "tool") -> DataFrame:
    """Features of every prefix at once, from one row a call: running counts instead of one featurisation a step."""
    w = Window.partitionBy(trial).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = calls.withColumn("prefix_len", F.row_number().over(w))
    n = lambda names: F.sum(F.col(tool).isin(*names).cast("int")).over(run)
    at = lambda names: F.coalesce(F.min(F.when(F.col(tool).isin(*names), F.col("prefix_len") - 1)).over(run), F.col("prefix_len"))
    out = out.withColumns({"n_reads": n(READS), "n_writes": n(WRITES), "n_exec": n(EXECS), "n_search": n(("search_tool",)), "first_write_pos": at(WRITES), "first_exec_pos": at(EXECS), "_read": at(READS), "_kinds": F.size(F.collect_set(tool).over(run))})
    size = F.col("prefix_len")
    return out.withColumns(
        {
            "n_steps": size,
            "search_ratio": F.col("n_search") / size,
            "tool_diversity": F.col("_kinds") / size,
            "write_before_read": (F.col("first_write_pos") < size) & (F.col("_read") < size) & (F.col("first_write_pos") < F.col("_read")),
        }
    ).drop("_read", "_kinds")


# --------------------------------------------------------------- prediction
def feature_vector() -> list[Column]:
    return [F.log1p("first_write_pos"), F.log1p("first_exec_pos"), *(F.col(c).cast("double") for c in FEATURES[2:])]


@dataclass
class Predictor:
    """Logistic model over standardised features, after a fixed number of gradient steps."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray | None
    std: np.ndarray | None

    def probability(self) -> Column:
        """P(high outcome) as a column of literals: one fused JVM expression."""
        if self.mean is None:
            return F.lit(0.5)
        z = F.lit(float(self.bias))
        for x, w, m, s in zip(feature_vector(), self.weights, self.mean, self.std, strict=True):
            z = z + (x - float(m)) / float(s) * float(w)
        return sigmoid(z)


def _descend(x: np.ndarray, y: np.ndarray, n: np.ndarray, rate: float = 0.1, steps: int = 50):
    total = n.sum()
    mean = (n[:, None] * x).sum(0) / total
    std = np.sqrt((n[:, None] * (x - mean) ** 2).sum(0) / total) + 1e-6
    z = (x - mean) / std
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        e = n * (1 / (1 + np.exp(-np.clip(z @ w + b, -700, 700))) - y)
        w, b = w - rate * (z.T @ e) / total, b - rate * e.sum() / total
    return Predictor(w, b, mean, std)


def _design(df: DataFrame, most: int):
    """Different (features, outcome) rows with their counts: what the fit needs, whatever the number of trials."""
    grouped = df.select(*(c.alias(n) for c, n in zip(feature_vector(), FEATURES, strict=True)), (F.col("score") >= 0.5).cast("double").alias("y")).groupBy(*FEATURES, "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = grouped.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} different feature rows")
    return rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), rows["n"].to_numpy(float)


def fit_predictor(df: DataFrame, most: int = 2_000_000) -> Predictor:
    x, y, n = _design(df, most)
    return _descend(x, y, n) if len(x) else Predictor(np.zeros(len(FEATURES)), 0.0, None, None)


def loo_accuracy(df: DataFrame, most: int = 20_000) -> float:
    """Leave-one-out accuracy: one fit for each different row, in parallel."""
    x, y, n = _design(df, most)
    if n.sum() < 2:
        return 0.0

    def run(batches):
        for batch in batches:
            hits = []
            for i in batch.column(0).to_pylist():
                m = n.copy()
                m[i] -= 1
                p = _descend(x[m > 0], y[m > 0], m[m > 0])
                z = ((x[i] - p.mean) / p.std) @ p.weights + p.bias
                hits.append(float(n[i] * ((z >= 0) == (y[i] == 1))))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.float64())], names=["h"])

    got = df.sparkSession.range(len(x)).mapInArrow(run, "h double").agg(F.sum("h")).head()[0]
    return got / n.sum()


def check(df: DataFrame, predictor: Predictor) -> DataFrame:
    """Adds p_high, prediction (uncertain in [0.35, 0.65)), confidence, warning, recommendation to featurised rows."""
    df = df.withColumn("p_high", predictor.probability())
    p = F.col("p_high")
    df = df.withColumn("prediction", F.when((p >= 0.35) & (p < 0.65), "uncertain").when(p >= 0.5, "high").otherwise("low"))
    df = df.withColumn("confidence", F.when(F.col("prediction") == "uncertain", 1 - F.abs(p - 0.5) * 2).when(F.col("prediction") == "high", p).otherwise(1 - p))
    low = F.col("prediction") == "low"
    cases = [
        ((F.col("n_search") > 5) & (F.col("n_exec") == 0), F.lit("Much searching and nothing executed: runs that end high execute early."), F.lit("Write a minimal implementation and test it now.")),
        ((F.col("first_write_pos") > 10) & (F.col("n_exec") == 0), F.concat(F.col("first_write_pos").cast("string"), F.lit(" tool calls without code written or executed: runs that end low look like this.")), F.lit("Write a skeleton solution and iterate on it.")),
        ((F.col("n_steps") > 20) & (F.col("n_exec") < 2), F.lit("A long trajectory with hardly any execution."), F.lit("Implement, execute and verify in short loops.")),
        (F.lit(True), F.lit("The pattern is that of runs that ended low."), F.lit("Look at similar successful trajectories and try another approach.")),
    ]
    warning = recommendation = F
    for cond, w, r in cases:
        warning, recommendation = warning.when(low & cond, w), recommendation.when(low & cond, r)
    return df.withColumns({"warning": warning, "recommendation": recommendation})


def phase_tag(tool: Column) -> Column:
    return F.when(tool.isin("write_file", "write_todos"), "write").when(tool.isin(*EXECS), "exec").when(tool.isin(*READS), "read").when(tool == "search_tool", "search").otherwise("other")


def phase_boundaries(prefixes: DataFrame, trial: str, min_confidence: float = 0.7, most: int = 5, tool: str = "tool") -> DataFrame:
    """First ``most`` prefixes of each trial with a confident prediction or another phase than before (needs p_high)."""
    w = Window.partitionBy(trial).orderBy("prefix_len")
    tagged = prefixes.withColumn("phase_tag", phase_tag(F.col(tool)))
    tagged = tagged.withColumn("_before", F.lag("phase_tag").over(w))
    hit = (F.col("p_high") >= min_confidence) | (F.col("p_high") <= 1 - min_confidence) | (F.col("_before").isNotNull() & (F.col("_before") != F.col("phase_tag")))
    return tagged.where(hit).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("_before")


def divergence_steps(high: DataFrame, low: DataFrame, pair: str, min_confidence: float = 0.7, most: int = 5) -> DataFrame:
    """Prefix lengths at which the high run is confidently high and the low one confidently low."""
    a = high.select(pair, "prefix_len", F.col("p_high").alias("_a"))
    b = low.select(pair, "prefix_len", F.col("p_high").alias("_b"))
    w = Window.partitionBy(pair).orderBy("prefix_len")
    hit = a.join(b, [pair, "prefix_len"]).where((F.col("prefix_len") <= most * 3) & (F.col("_a") >= min_confidence) & (F.col("_b") <= 1 - min_confidence))
    return hit.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select(pair, "prefix_len")


# --------------------------------------------------------------- similarity
def tool_weights(df: DataFrame, key: str, sequence: str = "tool_sequence") -> DataFrame:
    """(key, tool, weight): bag of tools scaled to length 1, sparse."""
    bag = df.select(key, F.explode(sequence).alias("tool")).groupBy(key, "tool").agg(F.count(F.lit(1)).alias("_n"))
    norms = bag.groupBy(key).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    return bag.join(norms, key).select(key, "tool", (F.col("_n") / F.col("_norm")).alias("weight"))


def recoverable_highs(records: DataFrame) -> DataFrame:
    """Adds outcome class (0.75, 0.25) and whether a high run's task also has a run below 0.5."""
    low = records.groupBy("task_path").agg(F.bool_or(F.col("score") < 0.5).alias("_low"))
    kind = F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.25, "medium").otherwise("low")
    return records.join(low, "task_path").withColumn("outcome_class", kind).withColumn("is_recoverable_high", (kind == "high") & F.col("_low")).drop("_low")


def task_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def retrieve(records: DataFrame, description: str, sequence: list[str] | None = None, k: int = 5, outcome: str | None = None) -> DataFrame:
    """Memories for one task: ``retrieval.retrieve_many`` with a single query, and the records' own columns."""
    marked = recoverable_highs(records)
    asked = records.sparkSession.createDataFrame([(1, description, list(sequence or []), outcome)], "query_id int, description string, tool_sequence array<string>, outcome string")
    best = retrieval.retrieve_many(marked, asked, k).drop("query_id")
    return marked.join(F.broadcast(best), "trial_id").orderBy("rank")  # k rows
