"""Tables kept up to date by streams: memories that are upserted, and the log of improvement cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from episodeframe.operators.trajectory import recoverable_highs

BUCKETS = 64


class MemoryTable:
    """Remembered runs, one row for each (task_path, trial_id), in versions of buckets.

    A batch rewrites the buckets of its tasks as ``v=<batch + 1>/bucket=<b>`` from
    the versions before it, so a batch that is played again leaves the same table.
    A task's rows are all in one bucket; a late high or low run therefore changes
    the class and flag of the task's older rows too.  Of rows of one key the one
    with the greatest ``ord`` stays, of equal ones the later batch's; within a
    batch equal keys and ``ord`` are one row (the greatest).  Rows without task
    or trial are not remembered.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folder(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rows(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest version of each bucket; None where nothing is stored."""
        place, files = self._folder()
        if not files.exists(place) or not any(f.getPath().getName().startswith("v=") for f in files.listStatus(place)):
            return None
        stored = self.spark.read.parquet(self.path)
        if before is not None:
            stored = stored.where(F.col("v") < before)
        if buckets is not None:
            stored = stored.where(F.col("bucket").isin(buckets))
        # One row a bucket: the filter prunes all other folders.
        newest = [(r["bucket"], r["v"]) for r in stored.groupBy("bucket").agg(F.max("v").alias("v")).collect()]
        if not newest:
            return None
        keep = F.lit(False)
        for v in sorted({v for _, v in newest}):
            keep = keep | ((F.col("v") == v) & F.col("bucket").isin([b for b, w in newest if w == v]))
        return stored.where(keep)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merge rows (trial_id, task_path, score, ord, ...) as batch ``batch_id``, counted from 0."""
        version = batch_id + 1
        bucket = F.pmod(F.xxhash64("task_path"), F.lit(self.buckets)).cast("int")
        new = batch.where(F.col("task_path").isNotNull() & F.col("trial_id").isNotNull()).withColumn("bucket", bucket).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            if not touched:
                return
            old = self._rows(version, touched)
            rows = new.withColumn("_new", F.lit(1))
            if old is not None:
                rows = rows.unionByName(old.drop("v", "outcome_class", "is_recoverable_high").withColumn("_new", F.lit(0)), allowMissingColumns=True)
            columns = [c for c in rows.columns if c not in ("task_path", "trial_id", "_new")]
            last = F.max(F.struct("ord", "_new", *(c for c in columns if c != "ord"))).alias("last")
            one = rows.groupBy("task_path", "trial_id").agg(last).select("task_path", "trial_id", *(F.col(f"last.{c}").alias(c) for c in columns))
            recoverable_highs(one).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        finally:
            new.unpersist()

    def read(self) -> DataFrame:
        rows = self._rows()
        if rows is None:
            raise ValueError(f"no memories in {self.path}")
        return rows.drop("v", "bucket")

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions of buckets that ``keep`` newer ones stand before; how many went."""
        place, files = self._folder()
        stored = self.spark.read.parquet(self.path).select("bucket", "v").distinct().collect()
        gone = 0
        for b in {r["bucket"] for r in stored}:
            for v in sorted((r["v"] for r in stored if r["bucket"] == b), reverse=True)[keep:]:
                gone += files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}/bucket={b}"), True)
        return gone

    def stream(self, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Upsert arriving records; the query to await or stop."""
        writer = records.writeStream.foreachBatch(lambda df, i: self.upsert(df, i)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def stream_cycle_log(cycles: DataFrame, by: str = "agent", plateau: float = 0.01) -> DataFrame:
    """(by, cycle, kappa) as cycles end -> the same with ``delta`` and ``plateaued``, like ``windows.kappa_changes``.

    State is the last cycle and its kappa of each agent.  A cycle not after the
    last one of its agent is late and dropped; cycles of one micro-batch are
    taken in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (None, None)
        rows = []
        for cycle, kappa in pd.concat(list(frames)).sort_values("cycle", kind="stable")[["cycle", "kappa"]].itertuples(index=False):
            if last is None or cycle > last:
                delta = None if before is None else float(kappa) - before
                rows.append((key[0], int(cycle), float(kappa), delta, delta is not None and abs(delta) < plateau))
                last, before = int(cycle), float(kappa)
        state.update((last, before))
        yield pd.DataFrame(rows, columns=[by, "cycle", "kappa", "delta", "plateaued"])

    kind = cycles.schema[by].dataType.simpleString()
    rows = cycles.select(by, F.col("cycle").cast("bigint").alias("cycle"), F.col("kappa").cast("double").alias("kappa")).where("cycle is not null and kappa is not null")
    return rows.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, cycle bigint, kappa double, delta double, plateaued boolean", "cycle bigint, kappa double", "append", GroupStateTimeout.NoTimeout)
