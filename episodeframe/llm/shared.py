"""Tables cut from their lineage, in the folder all machines share.

Intermediate tables are managed tables of a database of their own whose folder
lies below ``spark.checkpoint.dir``; dropping one removes its files.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATABASE = "episodeframe_work"
#: buckets of a ``RowStore`` at most (Spark's own bound)
MOST_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, on one machine (tests), a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (base or "file:///tmp/checkpoints").rstrip("/")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def restored(spark: SparkSession, *keys: str):
    """Settings of the session that are as before when the block ends."""
    with contextlib.ExitStack() as stack:
        for key in keys:
            before = spark.conf.get(key, None)
            stack.callback(spark.conf.unset, key) if before is None else stack.callback(spark.conf.set, key, before)
        yield


def _save(df: DataFrame, label: str, buckets: int = 0, by: str | None = None) -> DataFrame:
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_dir(spark)}/{DATABASE}'")
    name = f"{DATABASE}.{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    if buckets:
        writer = writer.bucketBy(buckets, by)
    # The shuffle files of the query go when the table is written.
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer.saveAsTable(name)
    table = spark.table(name)
    table.work_table = name
    return table


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    return _save(df, label)


def drop_table(table: DataFrame) -> None:
    """Remove a materialised table that nothing lazy refers to any more."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.work_table}")


class RowStore:
    """Rows that stay with the task that wrote them.

    Every row is named by ``(part, row)``: the partition that wrote it and its
    number.  The table is bucketed by ``part``, so a partition writes one file
    and nothing is dealt out; later joins on ``(part, row)`` move the other side
    (ids, counts, spans) to the rows and never the texts.
    """

    def __init__(self, df: DataFrame, label: str, row: str | None = None, buckets: int = 0) -> None:
        """``row``: a column that has the row numbers of a store already, of which ``df`` was made in its place."""
        spark = df.sparkSession
        # Bucketed by part, joined on (part, row): part alone may deal out the other side.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        if row is None:
            df = df.withColumn("row", F.monotonically_increasing_id())
        self.buckets = buckets or min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = _save(df.withColumn("part", part_of("row")), label, self.buckets, "part")

    def select(self, *columns: str) -> DataFrame:
        return self.table.select("part", "row", *columns)

    def join(self, other: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
        """``other`` has ``row``; its rows come to the stored ones."""
        return self.select(*columns).join(other.withColumn("part", part_of("row")), ["part", "row"], how)

    def drop(self) -> None:
        drop_table(self.table)


def part_of(row: str):
    """The partition in a row number of ``monotonically_increasing_id``."""
    return F.shiftright(F.col(row), 33).cast("int")


def bounded_batches(docs: DataFrame, rows: int = 2000, size: str = "4m") -> DataFrame:
    """Keep Arrow batches of texts small: their buffers live outside the heap, on both sides."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return docs


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under the operator's own names."""
    bounded_batches(docs)
    return docs.select(*(docs[c].alias(n) for n, c in columns.items()))
