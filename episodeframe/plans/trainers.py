"""Trainers: what becomes of a plan.  Each writes the preference examples and returns (task, score)."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.plans import curriculum


def write_examples(plan: DataFrame, path: str) -> str:
    """The preference examples as JSON lines, in a folder of part files."""
    curriculum.preference_examples(plan).write.mode("overwrite").json(path)
    return path


class Trainer(ABC):
    """``train`` leaves ``examples`` below ``out`` and calls ``scores``."""

    def train(self, plan: DataFrame, out: str) -> DataFrame:
        examples = write_examples(plan, f"{out.rstrip('/')}/examples")
        return self.scores(plan, examples, out)

    @abstractmethod
    def scores(self, plan: DataFrame, examples: str, out: str) -> DataFrame: ...


class ConstantTrainer(Trainer):
    """Trains nothing: every task gets the same score."""

    def __init__(self, score: float = 0.99) -> None:
        self.score = score

    def scores(self, plan: DataFrame, examples: str, out: str) -> DataFrame:
        return plan.select("task", F.lit(self.score).alias("score"))


class PredictedTrainer(Trainer):
    """Trains nothing: every task comes out as predicted."""

    def scores(self, plan: DataFrame, examples: str, out: str) -> DataFrame:
        return curriculum.simulated_training(plan)


class ConfigTrainer(Trainer):
    """Writes the YAML of a preference-training run for another program; the scores (1 where there are examples) are placeholders."""

    def __init__(self, base_model: str) -> None:
        self.base_model = base_model

    def scores(self, plan: DataFrame, examples: str, out: str) -> DataFrame:
        os.makedirs(out, exist_ok=True)
        with open(f"{out.rstrip('/')}/train.yaml", "w", encoding="utf-8") as f:
            f.write(curriculum.trainer_config(self.base_model, os.path.abspath(examples), out))
        return curriculum.preference_examples(plan).select("task").distinct().withColumn("score", F.lit(1.0))


class LibraryTrainer(Trainer):
    """Stands for a trainer of the ``trl`` package, which must be there; runs no training, and its scores (1) are placeholders."""

    def __init__(self, base_model: str) -> None:
        self.base_model = base_model

    def scores(self, plan: DataFrame, examples: str, out: str) -> DataFrame:
        import trl  # noqa: F401

        return curriculum.preference_examples(plan).select("task").distinct().withColumn("score", F.lit(1.0))


def trainer(name: str, base_model: str = "model") -> Trainer:
    made = {"noop": ConstantTrainer, "simulated": PredictedTrainer, "trl": lambda: LibraryTrainer(base_model), "axolotl": lambda: ConfigTrainer(base_model)}
    if name not in made:
        raise ValueError(f"no trainer {name!r}; there are {', '.join(made)}")
    return made[name]()
