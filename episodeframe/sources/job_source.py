"""Job folders as a Spark data source: ``spark.read.format("agent_jobs")``, its stream and its sink.

A job is a folder of trials; a trial is a folder with ``result.json`` and other
files.  One listing of each job plans the read: trials in the order of their
names, so that ``place`` needs no sort.  Tasks open only the files of the kinds
that are asked for.  Files are reached through ``pyarrow.fs``, on a local disk or
a store that all machines share.

Options: ``paths`` (a JSON list of jobs, in place of the one ``path``), ``kinds``
(comma-separated, all by default), ``needs`` (kinds without which a trial isn't
one, ``result`` by default), ``deeper`` (a job without such trials is looked into
one level deeper), ``trials_per_task``, and for streams ``settle`` (seconds).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "agent_jobs"
#: the files of a trial by the column that holds their text
KINDS = {"result": "result.json", "config": "config.json", "reward_json": "verifier/reward.json", "reward_txt": "verifier/reward.txt", "trajectory": "agent/trajectory.json"}
TRIALS_PER_TASK = 256
#: texts that a task holds before it hands them over, a longer one alone
BATCH_BYTES = 4 << 20
SETTLE = 2.0


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path.rstrip("/") or "/")


def subfolders(files: fs.FileSystem, folder: str) -> list[str]:
    """Names of the folders in ``folder``, sorted; none where it isn't there."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


@dataclass
class Trials(InputPartition):
    """Trials of one job: their folders' names below ``job`` and the place of the first."""

    run: int
    job: str
    first: int
    names: list[str]

    def __init__(self, run: int, job: str, first: int, names: list[str]) -> None:
        super().__init__(None)
        self.run, self.job, self.first, self.names = run, job, first, names


class _Options:
    """What reader and stream have in common; it travels to the tasks."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        listed = options.get("paths")
        self.jobs = [j.rstrip("/") for j in (json.loads(listed) if listed else [options["path"]])]
        self.kinds = [f.name for f in schema if f.name in KINDS]
        self.needs = [k.strip() for k in options.get("needs", "result").split(",") if k.strip()]
        if unknown := set(self.needs) - KINDS.keys():
            raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")
        self.deeper = str(options.get("deeper", "false")).lower() == "true"
        self.per_task = int(options.get("trials_per_task", TRIALS_PER_TASK))
        self.settle = float(options.get("settle", SETTLE))
        self.columns = schema.names
        self.arrow = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string())) for f in schema])

    def is_trial(self, files: fs.FileSystem, folder: str, names: list[str]) -> list[bool]:
        """Which of the folders have all files a trial needs."""
        wanted = [f"{folder}/{n}/{KINDS[k]}" for n in names for k in self.needs]
        there = [f.type == fs.FileType.File for f in files.get_file_info(wanted)] if wanted else []
        width = len(self.needs)
        return [all(there[i * width : (i + 1) * width]) for i in range(len(names))]

    def read(self, part: Trials) -> Iterator[pa.RecordBatch]:
        files, root = opened(part.job)
        rows: list[tuple] = []
        size = 0
        for place, name in enumerate(part.names, part.first):
            texts = {}
            for kind in dict.fromkeys([*self.needs, *self.kinds]):
                try:
                    with files.open_input_stream(f"{root}/{name}/{KINDS[kind]}") as f:
                        texts[kind] = f.read().decode("utf-8", "replace")
                except (FileNotFoundError, NotADirectoryError):
                    texts[kind] = None
            if any(texts[k] is None for k in self.needs):
                continue
            values = {"run": part.run, "job": part.job, "trial": f"{part.job}/{name}", "place": place, **texts}
            rows.append(tuple(values[c] for c in self.columns))
            size += sum(len(t) for t in texts.values() if t)
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)

    def split(self, run: int, job: str, names: list[str], first: int = 0) -> list[Trials]:
        return [Trials(run, job, first + i, names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]


class JobReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> list[Trials]:
        out = []
        for run, job in enumerate(self.options.jobs):
            files, root = opened(job)
            names = subfolders(files, root)
            if self.options.deeper and not any(self.options.is_trial(files, root, names)):
                names = [f"{n}/{m}" for n in names for m in subfolders(files, f"{root}/{n}")]
            out += self.options.split(run, job, names)
        return out or [Trials(0, self.options.jobs[0], 0, [])]

    def read(self, partition: Trials) -> Iterator[pa.RecordBatch]:
        yield from self.options.read(partition)


class JobStream(DataSourceStreamReader):
    """Trials in the order in which their last needed file was written.

    The offset is the time and folder of the last trial taken, so it stays small
    however many trials there are.  A trial is taken once its files are older
    than ``settle`` seconds; until then others with the same time may come.  A
    trial whose file is dated before the offset when it appears is never taken,
    and one rewritten after it was taken comes again.
    """

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": -1, "run": -1, "name": ""}

    def _between(self, start: tuple | None, end: tuple) -> list[tuple]:
        """(time, run, name) of the trials after ``start``, up to ``end``, in order."""
        out = []
        for run, job in enumerate(self.options.jobs):
            files, root = opened(job)
            names = subfolders(files, root)
            width = len(self.options.needs)
            wanted = [f"{root}/{n}/{KINDS[k]}" for n in names for k in self.options.needs]
            found = files.get_file_info(wanted) if wanted else []
            for i, name in enumerate(names):
                mine = found[i * width : (i + 1) * width]
                if all(f.type == fs.FileType.File for f in mine):
                    at = (max(f.mtime_ns for f in mine), run, name)
                    if at <= end and (start is None or at > start):
                        out.append(at)
        return sorted(out)

    def latestOffset(self) -> dict:
        settled = (int((time.time() - self.options.settle) * 1e9), len(self.options.jobs), "")
        last = max(self._between(None, settled), default=(-1, -1, ""))
        return dict(zip(("time", "run", "name"), last, strict=True))

    def partitions(self, start: dict, end: dict) -> list[Trials]:
        key = lambda o: (o["time"], o["run"], o["name"])
        by_job: dict[int, list[str]] = {}
        for _, run, name in self._between(key(start), key(end)):
            by_job.setdefault(run, []).append(name)
        return [p for run, names in by_job.items() for p in self.options.split(run, self.options.jobs[run], sorted(names))]

    def read(self, partition: Trials) -> Iterator[pa.RecordBatch]:
        yield from self.options.read(partition)


class JobWriter(DataSourceWriter):
    """Writes ``trial`` (the folder's name) and texts as a job.

    Every file is written beside its place and moved there, so a task that is
    tried again or twice at once leaves whole files only.
    """

    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = path.rstrip("/"), columns, overwrite
        if "trial" not in columns or (other := set(columns) - KINDS.keys() - {"trial"}):
            raise ValueError("a job has the columns trial and " + ", ".join(KINDS) if "trial" not in columns else f"no file for: {', '.join(sorted(other))}")
        if overwrite:
            files, root = opened(self.path)
            if files.get_file_info(root).type == fs.FileType.Directory:
                files.delete_dir_contents(root)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, root = opened(self.path)
        attempt = TaskContext.get().taskAttemptId()
        for row in iterator:
            name = row["trial"]
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not the name of a trial: {name!r}")
            for kind, place in KINDS.items():
                if kind in self.columns and row[kind] is not None:
                    final = f"{root}/{name}/{place}"
                    files.create_dir(final.rsplit("/", 1)[0], recursive=True)
                    with files.open_output_stream(f"{final}.{attempt}") as f:
                        f.write(row[kind].encode("utf-8"))
                    files.move(f"{final}.{attempt}", final)
        return WriterCommitMessage()


class AgentJobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        kinds = [k.strip() for k in self.options.get("kinds", ",".join(KINDS)).split(",") if k.strip()]
        if unknown := set(kinds) - KINDS.keys():
            raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")
        return ", ".join(["run int", "job string", "trial string", "place bigint", *(f"{k} string" for k in kinds)])

    def reader(self, schema: StructType) -> JobReader:
        return JobReader(_Options(schema, self.options))

    def streamReader(self, schema: StructType) -> JobStream:
        return JobStream(_Options(schema, self.options))

    def writer(self, schema: StructType, overwrite: bool) -> JobWriter:
        return JobWriter(self.options["path"], schema.names, overwrite)


def read_texts(spark: SparkSession, jobs: list[str], kinds: tuple[str, ...], needs: str = "result", deeper: bool = False) -> DataFrame:
    """(run, job, trial, place, texts) of the trials of several jobs."""
    spark.dataSource.register(AgentJobs)
    reader = spark.read.format(NAME).option("paths", json.dumps(jobs)).option("kinds", ",".join(kinds))
    return reader.option("needs", needs).option("deeper", str(deeper).lower()).load()


def stream_texts(spark: SparkSession, jobs: list[str], kinds: tuple[str, ...], needs: str = "result", settle: float = SETTLE) -> DataFrame:
    """The same as trials appear."""
    spark.dataSource.register(AgentJobs)
    reader = spark.readStream.format(NAME).option("paths", json.dumps(jobs)).option("kinds", ",".join(kinds))
    return reader.option("needs", needs).option("settle", str(settle)).load()


def write_job(trials: DataFrame, path: str) -> None:
    """Trials as a job folder: ``trial`` is the folder's name, other columns are the texts of its files (null: no file)."""
    trials.sparkSession.dataSource.register(AgentJobs)
    trials.write.format(NAME).mode("append").save(path)
