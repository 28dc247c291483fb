"""Tables that go to JSON and come back: memories, pools, plans, simulation results.

A pool or a plan is one JSON document of any size: a folder of text parts which,
put together in the order of their names, are the document.  Every entry of a
list has a line of its own, so tasks write and read parts of it side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeframe.operators.scans import row_numbers
from episodeframe.schema import MEMORY, POOL

#: characters of a value that Spark's sample for dealing rows may hold
BEGINNING = 64


def write_memories(memories: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Trajectory records as JSON lines."""
    memories.select(*MEMORY.names).write.mode(mode).json(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    return _required(spark.read.schema(MEMORY).json(path), ["trial_id", "score", "tool_sequence"])


def write_document(sections: list[tuple[str, DataFrame]], closing: str, path: str) -> None:
    """Lists of JSON values as one document: each section is (text before its list, rows (place, value) in order of ``place``).

    The texts open and close the lists; commas come after all values but a
    section's last one.
    """
    spark = sections[0][1].sparkSession
    lines = None
    texts = [text for text, _ in sections]
    for i, (_, rows) in enumerate(sections):
        # A value may be long (all pairs of a task): its beginning deals rows of one place, the whole of it sorts them.
        numbered = row_numbers(rows.select("place", "value"), ["place", F.substring("value", 1, BEGINNING)], "_at", ["value"])
        total = numbered.agg(F.count(F.lit(1)).alias("_all"))
        comma = F.when(F.col("_at") < F.col("_all"), ",").otherwise("")
        part = numbered.crossJoin(F.broadcast(total)).select(F.lit(2 * i + 1).alias("_section"), "_at", F.concat("value", comma).alias("value"))  # one row beside all
        lines = part if lines is None else lines.unionByName(part)
    frame = spark.createDataFrame([(2 * i, 0, t) for i, t in enumerate([*texts, closing])], "_section int, _at bigint, value string")
    lines.unionByName(frame).orderBy("_section", "_at").select("value").write.mode("overwrite").text(path)


def _entries(spark: SparkSession, path: str, opening: str, kind: T.StructType) -> DataFrame | None:
    """(_i, fields) of a document's entries by lines; None for a document that is laid out otherwise."""
    lines = spark.read.text(path)
    if lines.where(F.col("value").endswith(opening)).isEmpty():
        return None
    # Parsed behind the condition: Spark may evaluate later filters on the parsed value first.
    entry = F.col("value").startswith("{") & ~F.col("value").endswith("[")
    body = F.when(entry, F.regexp_replace("value", ",$", ""))
    ours = lines.where(entry).select(F.monotonically_increasing_id().alias("_i"), F.from_json(body, kind, {"mode": "FAILFAST"}).alias("r"))
    return ours.select("_i", "r.*")


def write_pool(pool: DataFrame, path: str) -> None:
    """One document: count, agents and tasks by name, records in order."""
    named = lambda c: pool.select(F.col(c).alias("place")).where(F.col(c).isNotNull()).distinct().select("place", F.to_json(F.array("place")).alias("_list")).select("place", F.expr("substring(_list, 2, length(_list) - 2)").alias("value"))
    records = pool.select(F.col("ord").alias("place"), F.to_json(F.struct(*POOL.names)).alias("value"))
    write_document([(f'{{"n_records":{pool.count()},"agents":[', named("agent_name")), ('],"tasks":[', named("task")), ('],"records":[', records)], "]}", path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Records of pool documents; absent optional fields get their defaults."""
    schema = T.StructType([T.StructField("records", T.ArrayType(POOL))])
    rows = _entries(spark, path, '"records":[', POOL)
    if rows is None:
        rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("records").alias("_i", "r")).select("_i", "r.*")
    rows = rows.withColumns(
        {
            "ord": F.coalesce("ord", F.col("_i").cast("bigint")),
            "checkpoint_scores": F.coalesce("checkpoint_scores", F.create_map().cast("map<string,double>")),
            "success": F.coalesce("success", F.lit(False)),
            "sub_task_depth": F.coalesce("sub_task_depth", F.lit(0)),
        }
    )
    return _required(rows.select(*POOL.names), ["agent_name", "model_name", "task", "score"])


def _required(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.when(F.col(k).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"missing required key '{k}'")).cast("boolean")))
    return df


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan as one JSON document with its tasks in training order."""
    fields = [c for c in plan.columns if c != "position"]
    tasks = plan.select(F.col("position").alias("place"), F.to_json(F.struct("position", *fields)).alias("value"))
    write_document([('{"curriculum":[', tasks)], "]}", path)


def read_plan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = _entries(spark, path, '"curriculum":[', schema)
    if rows is not None:
        return rows.orderBy("position").drop("_i") if "position" in schema.names else rows.drop("_i")
    doc = T.StructType([T.StructField("curriculum", T.ArrayType(schema))])
    return spark.read.schema(doc).option("multiLine", "true").json(path).select(F.inline("curriculum"))


def read_simulation(spark: SparkSession, path: str, agent: str) -> DataFrame | None:
    """(mean, ci_low, ci_high) of an agent from a results document, None where there is no such file."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    agents = F.from_json(F.get_json_object("value", "$.agents"), "map<string,struct<right_tail:struct<mean_gain:double,ci_low:double,ci_high:double>>>")
    return text.select(agents[agent]["right_tail"].alias("r")).where(F.col("r").isNotNull()).select(F.col("r.mean_gain").alias("mean"), "r.ci_low", "r.ci_high")
