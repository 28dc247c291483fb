"""Training plans from outcome profiles: pairs, predicted gains, recommendations, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.operators.scans import row_numbers

from episodeframe.functions.columns import basename


def training_pairs(runs: DataFrame, profiles: DataFrame, threshold: float = 0.9, name_map: dict[str, str] | None = None) -> DataFrame:
    """Every low run of a recoverable task with the task's best run.

    ``runs`` has task_path, score, traj_path; they meet the profiles on the last
    part of the task's path (after ``name_map``).
    """
    key = basename(F.col("task_path"))
    if name_map:
        table = F.create_map(*(F.lit(x) for pair in name_map.items() for x in pair))
        key = F.coalesce(table[key], key)
    p = profiles.where("kind = 'recoverable'").select("task", "q_star", "gap", basename(F.col("task")).alias("_key"))
    r = runs.select(key.alias("_key"), "score", "traj_path").join(p, "_key")
    high = r.where(F.col("score") >= threshold * F.col("q_star")).groupBy("_key").agg(F.max(F.struct(F.col("score"), F.col("traj_path"))).alias("h"))
    low = r.where(F.col("score") < threshold * F.col("q_star"))
    return low.join(high, "_key").select("task", F.col("h.traj_path").alias("reinforce_path"), F.col("traj_path").alias("contrast_path"), F.col("h.score").alias("reinforce_score"), F.col("score").alias("contrast_score"), (F.col("h.score") - F.col("score")).alias("pair_gap"))


def diverse(pairs: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Drops a pair whose reinforce run is closer than ``threshold`` to that of one kept before (within a task).

    Pairs of a task share the reinforce run, so with a threshold below 1 one pair
    a task is left; different runs are compared by their tool weights.
    """
    bags = weights.groupBy("traj_path").agg(F.map_from_entries(F.collect_list(F.struct("tool", "weight"))).alias("_bag"))
    rows = pairs.join(bags, pairs["reinforce_path"] == bags["traj_path"], "left").drop("traj_path")
    listed = rows.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("contrast_score", "contrast_path", "reinforce_path", "reinforce_score", "pair_gap", F.map_entries(F.coalesce("_bag", F.create_map().cast("map<string,double>"))).alias("bag")))).alias("_p"))
    cosine = lambda a, b: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.map_from_entries(b)[x["key"]], F.lit(0.0)))
    kept = F.aggregate("_p", F.slice("_p", 1, 0), lambda acc, p: F.when(F.exists(acc, lambda q: cosine(q["bag"], p["bag"]) > threshold), acc).otherwise(F.concat(acc, F.array(p))))
    return listed.select("task", F.inline(kept)).drop("bag")


def predicted_gains(profiles: DataFrame, alpha: float = 0.4, simulated: DataFrame | None = None) -> DataFrame:
    """Adds predicted_gain and its interval: ``simulated`` one-row results if given, else alpha * gap * consistency (x 0.7, x 1.3)."""
    if simulated is not None:
        s = simulated.select(F.col("mean").alias("predicted_gain"), F.col("ci_low").alias("gain_low"), F.col("ci_high").alias("gain_high"))
        return profiles.crossJoin(F.broadcast(s.limit(1)))
    gain = F.lit(alpha) * F.col("gap") * F.col("consistency")
    four = lambda c: F.bround(c, 4)
    return profiles.withColumns({"predicted_gain": four(gain), "gain_low": four(gain * 0.7), "gain_high": four(gain * 1.3)})


def build_plan(profiles: DataFrame, pairs: DataFrame, by_information: bool = False) -> DataFrame:
    """One row a recoverable task in training order: priority, predicted gain, its pairs as an array, a recommendation.

    Priorities that are equal to nine places go by the task's name.
    """
    priority = "priority_eig" if by_information else "priority"
    listed = pairs.groupBy("task").agg(F.array_sort(F.collect_list(F.struct(F.col("contrast_score"), F.col("contrast_path"), F.col("reinforce_path"), F.col("reinforce_score"), F.col("pair_gap")))).alias("training_pairs"))
    plan = predicted_gains(profiles.where("kind = 'recoverable'")).join(listed, "task", "left")
    n, first = F.coalesce(F.size("training_pairs"), F.lit(0)), F.col("training_pairs")[0]
    text = F.when(F.col("training_pairs").isNull(), F.format_string("%s has no pair of runs yet: run it more often.", "task")).otherwise(
        F.format_string("Train on %d pair(s): reinforce %.2f against %.2f, a gap of %.2f.", n, first["reinforce_score"], first["contrast_score"], first["pair_gap"])
    )
    numbers = row_numbers(profiles.where("kind = 'recoverable'").select("task", F.round(priority, 9).alias("_p")), [F.desc("_p"), "task"], "position").select("task", F.col("position").cast("int").alias("position"))
    return plan.join(numbers, "task").select("task", "difficulty", "q_star", "q_bar", "gap", "consistency", "outcome_entropy", F.col(priority).alias("priority"), "predicted_gain", "gain_low", "gain_high", "training_pairs", text.alias("recommendation"), "position")


def plan_summary(plan: DataFrame, report: DataFrame) -> DataFrame:
    """One row: counts and sums of the report, the predicted total (null when 0) and whether nothing is left to recover."""
    total = plan.agg(F.sum("predicted_gain").alias("_t"), F.count(F.lit(1)).alias("n_planned"))
    return report.crossJoin(total).select(report["*"], "n_planned", F.when(F.col("_t") != 0, F.col("_t")).alias("predicted_total"), (F.col("n_recoverable") == 0).alias("cycle_complete"))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose keys weren't seen."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_src"))).where("_n = 1").drop("_n", "_src")


def preference_examples(plan: DataFrame) -> DataFrame:
    """(task, chosen, rejected, chosen_score, rejected_score) of all pairs with both trajectories."""
    p = plan.select("task", F.inline("training_pairs"))
    return p.where(F.col("reinforce_path").isNotNull() & F.col("contrast_path").isNotNull()).select("task", F.col("reinforce_path").alias("chosen"), F.col("contrast_path").alias("rejected"), F.col("reinforce_score").alias("chosen_score"), F.col("contrast_score").alias("rejected_score"))


def simulated_training(plan: DataFrame) -> DataFrame:
    """(task, score) after training as predicted: q_star plus the gain, 0.05 where none is known, at most 1."""
    return plan.select("task", F.least(F.lit(1.0), F.col("q_star") + F.coalesce("predicted_gain", F.lit(0.05))).alias("score"))


def trainer_config(base_model: str, dataset_path: str, output_dir: str) -> str:
    """YAML of a preference-training run over the exported examples."""
    values = {"base_model": base_model, "rl": "dpo", "output_dir": output_dir, "sequence_len": 4096, "num_epochs": 1, "micro_batch_size": 1, "gradient_accumulation_steps": 1, "learning_rate": "5e-7"}
    lines = [f"{k}: {v}" for k, v in values.items()]
    return "\n".join([*lines[:2], "datasets:", f"  - path: {dataset_path}", "    type: json", *lines[2:]]) + "\n"
