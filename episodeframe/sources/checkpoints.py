"""Checkpoints of shell test scripts: where a script adds to SCORE, by how much, and why.

A script is read once from top to bottom.  White space and case don't matter
for what counts as an addition (``SCORE=$((SCORE + 2))``, ``SCORE=$[SCORE+2]``,
``SCORE=$(expr $SCORE + 2)``) or as the stated total (``$SCORE / 5`` printed by
``python3 -c`` or ``echo``).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "task_name string, index int, checkpoint_id string, description string, reward_weight double, score_increment int, total_score int, condition_source string"
LONGEST, NEAR = 80, 3

#: what may stand between ``SCORE=`` and the number that is added, without white space
_SUMS = ("$((score+", "$[score+", "$(expr$score+")
#: what stands before the total, without white space
_SHARES = ("python3-c\"print($score/", "python3-c'print($score/", 'echo"$score/')


def _squeezed(line: str) -> str:
    return "".join(line.split()).lower()


def _leading_number(text: str) -> int | None:
    digits = "".join(takewhile(str.isdecimal, text))
    return int(digits) if digits else None


def additions(line: str) -> list[int]:
    """The numbers that a line adds to the score."""
    parts = _squeezed(line).split("score=")[1:]
    found = (_leading_number(p.removeprefix(s)) for p in parts for s in _SUMS if p.startswith(s))
    return [n for n in found if n is not None]


def stated_total(line: str) -> int | None:
    """The number by which a line divides the score for printing."""
    text = _squeezed(line)
    for share in _SHARES:
        before, sign, rest = text.partition(share)
        if sign and (n := _leading_number(rest)) is not None:
            return n
    return None


def _between(text: str, opening: str, closing: str) -> str | None:
    """What stands in quotes after ``opening`` and before ``closing``."""
    for quote in "'\"":
        _, sign, rest = text.partition(opening + quote)
        name, end, tail = rest.partition(quote)
        if sign and end and name and tail.lstrip().startswith(closing):
            return name
    return None


@dataclass
class _Reader:
    """What has been read since the last line of each kind that ends it."""

    comments: list[str] = field(default_factory=list)
    guard: list[str] = field(default_factory=list)
    near: deque = field(default_factory=lambda: deque(maxlen=NEAR))

    def take(self, line: str, adds: bool) -> None:
        bare = line.strip()
        if bare.startswith("#"):
            self.comments.append(bare.lstrip("#").strip())
        elif bare:
            self.comments.clear()
        # A blank line, an addition or an exit for a missing file ends a guard.
        if not bare or adds or bare.startswith(("if [ ! -f", "if [ ! -d")):
            self.guard.clear()
        else:
            self.guard.append(line)
        self.near.append(line)

    def description(self) -> str:
        text = " ".join(self.comments)
        for word in ("check", "validate", "test"):
            if text.lower().startswith(word):
                text = text[len(word) :].lstrip()
                text = text[1:] if text[:1] in (":", "-") else text
                break
        text = text.strip()
        if text:
            return text if len(text) <= LONGEST else text[: LONGEST - 3] + "..."
        near = "\n".join(self.near)
        if name := _between(near, "assert ", "in d"):
            return f"Key {name} present"
        if name := _between(near, "assert d[", "]"):
            return f"Field {name} correct"
        return "Checkpoint"


def parse(text: str, task: str) -> list[tuple]:
    """Rows of ``SCHEMA``; a script with a total only is one checkpoint; neither raises ValueError."""
    reader, total, added, found = _Reader(), None, 0, []
    for line in text.splitlines():
        amounts = additions(line)
        if amounts:
            found.append((amounts[0], reader.description(), "\n".join(reader.guard).strip()))
            added += sum(amounts)
        if total is None:
            total = stated_total(line)
        reader.take(line, bool(amounts))
    total = added if total is None else total
    if not total:
        raise ValueError(f"no score in the script of {task}")
    if not found:
        return [(task, 0, f"{task}::phase-0", "All-or-nothing task completion", 1.0, total, total, "")]
    return [(task, k, f"{task}::phase-{k}", about, add / total, add, total, guard) for k, (add, about, guard) in enumerate(found)]


def task_name(path: str) -> str:
    parts = path.split("/")
    if "tasks" in parts[:-1]:
        return parts[parts.index("tasks") + 1]
    return parts[-3] if len(parts) > 2 else "unknown"


def read_checkpoints(spark: SparkSession, tasks_dir: str) -> DataFrame:
    """Checkpoints of every ``tests/test.sh`` below a folder, one script at a time; scripts without a score are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "test.sh").load(tasks_dir).where(F.col("path").endswith("/tests/test.sh")).select("path", "content")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += parse(raw.decode("utf-8"), task_name(path))
                except (ValueError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[SCHEMA.split(", ")[i].split()[1]]) for i in range(len(names))], names=names)

    return files.mapInArrow(run, SCHEMA)
