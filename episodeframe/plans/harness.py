"""Running agents on tasks: value types, contracts, stubs, and batches as episode rows."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class ToolCall:
    function_name: str
    arguments: dict = field(default_factory=dict)
    tool_call_id: str = ""


@dataclass
class Observation:
    output: str = ""
    source_call_id: str = ""
    error: str | None = None


@dataclass
class Step:
    message: str = ""
    tool_calls: list[ToolCall] = field(default_factory=list)
    observations: list[Observation] = field(default_factory=list)


@dataclass
class TaskSpec:
    id: str
    instruction: str = ""
    difficulty: str | None = None
    metadata: dict = field(default_factory=dict)


@dataclass
class VerificationResult:
    score: float
    success: bool
    failure_mode: str | None = None
    criteria: dict = field(default_factory=dict)


@dataclass
class AgentContext:
    task: TaskSpec
    max_steps: int
    memory_prompt: str = ""
    steps: list[Step] = field(default_factory=list)


class Agent(ABC):
    @abstractmethod
    def run_step(self, context: AgentContext) -> Step: ...

    @abstractmethod
    def is_done(self, context: AgentContext) -> bool: ...


class ToolExecutor(ABC):
    @abstractmethod
    def execute(self, call: ToolCall, context: AgentContext) -> Observation: ...


class Verifier(ABC):
    @abstractmethod
    def verify(self, task: TaskSpec, context: AgentContext) -> VerificationResult: ...


class NoOpAgent(Agent):
    def run_step(self, context: AgentContext) -> Step:
        return Step(message="no-op")

    def is_done(self, context: AgentContext) -> bool:
        return True


class NoOpToolExecutor(ToolExecutor):
    def execute(self, call: ToolCall, context: AgentContext) -> Observation:
        return Observation("", call.tool_call_id)


class BinaryVerifier(Verifier):
    def __init__(self, score: float = 1.0, success: bool = True) -> None:
        self.result = VerificationResult(score, success, None if success else "failed")

    def verify(self, task: TaskSpec, context: AgentContext) -> VerificationResult:
        return self.result


_COLUMNS = (("run_id", pa.string()), ("model", pa.string()), ("task", pa.string()), ("episode", pa.int32()), ("score", pa.float64()), ("success", pa.bool_()), ("difficulty", pa.string()), ("failure_mode", pa.string()), ("length", pa.int32()), ("meta", pa.string()), ("trajectory", pa.string()), ("ord", pa.int64()))
EPISODES = "run_id string, model string, task string, episode int, score double, success boolean, difficulty string, failure_mode string, length int, meta string, trajectory string, ord bigint"


class AgentHarness:
    """Runs episodes of an agent; a batch runs its episodes in parallel on the cluster."""

    def __init__(self, agent: Agent, executor: ToolExecutor | None = None, verifier: Verifier | None = None, agent_name: str = "agent", run_id: str = "run0", max_steps: int = 50, memory_prompt=None) -> None:
        self.agent, self.executor, self.verifier = agent, executor or NoOpToolExecutor(), verifier or BinaryVerifier()
        self.agent_name, self.run_id, self.max_steps, self.memory_prompt = agent_name, run_id, max_steps, memory_prompt

    def run_episode(self, task: TaskSpec, episode: int = 0) -> dict:
        """An episode row; ``trajectory`` is its JSON document."""
        context = AgentContext(task, self.max_steps, self.memory_prompt(task) if self.memory_prompt else "")
        for _ in range(self.max_steps):
            step = self.agent.run_step(context)
            context.steps.append(step)
            step.observations += [self.executor.execute(call, context) for call in step.tool_calls]
            if self.agent.is_done(context):
                break
        v = self.verifier.verify(task, context)
        steps = [{"message": s.message, "tool_calls": [asdict(c) for c in s.tool_calls], "observation": {"results": [asdict(o) for o in s.observations]}} for s in context.steps]
        return {
            "run_id": self.run_id, "model": self.agent_name, "task": task.id, "episode": episode, "score": float(v.score), "success": bool(v.success), "difficulty": task.difficulty, "failure_mode": v.failure_mode, "length": len(context.steps),
            "meta": json.dumps({"criteria": v.criteria, "memory_prompt": context.memory_prompt, **task.metadata}), "trajectory": json.dumps({"task_id": task.id, "agent": {"name": self.agent_name}, "steps": steps}), "ord": episode,
        }

    def run_batch(self, spark: SparkSession, tasks: list[TaskSpec], episodes_per_task: int = 1, parallel: int = 64) -> DataFrame:
        """Episode rows of all tasks; the harness, its agent included, must pickle."""
        plan = [(i, e) for i in range(len(tasks)) for e in range(episodes_per_task)]

        def run(batches):
            for batch in batches:
                rows = [self.run_episode(tasks[i], e) | {"ord": i * episodes_per_task + e} for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _COLUMNS], names=[n for n, _ in _COLUMNS])

        work = spark.createDataFrame(plan, "task int, episode int").repartition(max(1, min(parallel, len(plan))))
        df = work.mapInArrow(run, EPISODES)
        strata = F.when(F.col("difficulty").isNotNull(), F.create_map(F.lit("difficulty"), F.col("difficulty"))).otherwise(F.create_map().cast("map<string,string>"))
        return df.withColumn("strata", strata)


def run_repeated(eval_fn, n: int):
    """The union of ``n`` runs of ``eval_fn(i)``, episodes of run ``run_i``."""
    out = None
    for i in range(n):
        df = eval_fn(i).withColumn("run_id", F.lit(f"run_{i}"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
