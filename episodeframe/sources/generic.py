"""Generic JSON and JSONL records, and the canonical episode tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodeframe.frame import Episodes
from episodeframe.schema import EPISODE, STRATUM

THRESHOLD = 0.99
#: fields with a meaning of their own; every other text or number is a stratum
RESERVED = ("run_id", "model", "task", "episode", "score", "success", "trajectory", "metadata", "failure_mode", "length")

_TEXT, _WHOLE, _NUMBER, _FLAG, _MAP, _NULL = "^STRING", "^BIGINT", "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "^BOOLEAN", "^OBJECT", "^VOID"


def read_jsonl(spark: SparkSession, path: str) -> Episodes:
    """Canonical JSONL; a field outside the schema or a broken line raises."""
    raw = in_file_order(spark.read.text(path))
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, EPISODE.names)))
    bad = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", "))).cast("string"))
    rec = F.from_json(F.coalesce(bad, F.col("value")), EPISODE, {"mode": "FAILFAST"})
    return Episodes(_ordered(raw.select(rec.alias("r"), F.col("place").alias("_i")).select("r.*", "_i")))


def in_file_order(lines: DataFrame) -> DataFrame:
    """(value, place) of the lines that aren't blank; ``place`` ascends over files in name order and lines in theirs.

    Spark reads parts of files in an order of its own, so a part's rank by file
    and start is the high half of the place and the line's number in its task
    the low one.  Only the list of parts is sorted and broadcast; lines stay
    where they are read.
    """
    read = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_line"))
    parts = read.select("_file", "_part").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_part")) - 1)
    place = F.shiftleft(F.col("_rank").cast("bigint"), 33).bitwiseOR(F.col("_line").bitwiseAND((1 << 33) - 1))
    return read.where(F.trim("value") != "").join(F.broadcast(parts), ["_file", "_part"]).select("value", place.alias("place"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, errors) of the invalid lines of JSONL files; lines count from 1, blank ones too.

    Bad lines alone meet the counts of the parts of files before theirs.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_line"))
    parts = lines.groupBy("file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    bad = parsed(lines.where(F.trim("value") != "")).where(F.size("errors") > 0)
    return bad.join(parts, ["file", "_part"]).select("file", (F.col("_before") + F.col("_line") - F.col("_first") + 1).alias("line"), "errors")


def _ordered(df: DataFrame) -> DataFrame:
    """``ord`` from the file, else the place of the line (files in name order, lines in theirs)."""
    return df.withColumn("ord", F.coalesce("ord", "_i")).drop("_i").select(*EPISODE.names)


def read_parquet(spark: SparkSession, path: str) -> Episodes:
    """Episodes as Parquet: absent optional columns are null, null strata leave the map."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    promoted = [c for c in df.columns if c.startswith(STRATUM)]
    if "strata" not in df.columns:
        pairs = F.create_map(*(x for c in promoted for x in (F.lit(c[len(STRATUM) :]), F.col(c).cast("string")))) if promoted else F.create_map().cast("map<string,string>")
        df = df.withColumn("strata", F.map_filter(pairs, lambda k, v: v.isNotNull()))
    for field in EPISODE:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.monotonically_increasing_id() if field.name == "ord" else F.lit(None).cast(field.dataType))
    return Episodes(df.select(*EPISODE.names, *promoted))


_RULES = {"episode": (_WHOLE, "an int"), "success": (_FLAG, "a bool"), "metadata": (_MAP, "an object"), "difficulty": (_TEXT, "a string"), "trajectory": (_TEXT, "a string"), "failure_mode": (f"{_TEXT}|{_NULL}", "a string or null"), "length": (f"{_WHOLE}|{_NULL}", "an int or null")}


def parsed(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds the variant ``v`` of a JSON text and ``errors``: what is wrong with the record, an array, empty for a valid one.

    Texts are parsed, fields typed and errors found once a row: ``explode`` of
    one value keeps Spark from writing the expression into every use of it,
    filters above all.
    """
    once = lambda df, name, c: df.select("*", F.explode(F.array(c)).alias(name))
    df = once(raw, "v", F.expr(f"try_parse_json({value})"))
    kinds = [F.expr(f"schema_of_variant(variant_get(v, '$.{key}', 'variant'))").alias(key) for key in ("run_id", "model", "task", "score", *_RULES)]
    df = once(df, "_t", F.struct(F.expr("schema_of_variant(v)").alias("whole"), F.expr("try_variant_get(v, '$.score', 'double')").alias("number"), *kinds))
    return once(df, "errors", F.when(F.col("v").isNull(), F.array(F.lit("not a JSON object"))).otherwise(errors())).drop("_t")


def errors(t: str = "_t") -> Column:
    """Errors of a raw record from the types of its fields."""
    kind = lambda key: F.col(f"{t}.{key}")
    found = [F.when(~kind("whole").rlike("^OBJECT"), F.lit("record must be an object"))]
    for key in ("run_id", "model", "task"):
        found.append(F.when(kind(key).isNull(), F.lit(f"missing required field '{key}'")).when(~kind(key).rlike(_TEXT), F.lit(f"field '{key}' must be a string")))
    score = kind("score")
    found.append(F.when(score.isNull(), F.lit("missing required field 'score'")).when(~score.rlike(_NUMBER), F.lit("field 'score' must be a number")).when(~kind("number").between(0.0, 1.0), F.lit("field 'score' must be between 0.0 and 1.0")))
    for key, (allowed, name) in _RULES.items():
        found.append(F.when(kind(key).isNotNull() & ~kind(key).rlike(allowed), F.lit(f"field '{key}' must be {name}")))
    return F.array_compact(F.array(*found))


def convert(raw: DataFrame, value: str = "value", order: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Raw JSON texts -> episode columns plus ``errors``: rows with errors keep what could be read."""
    df = parsed(raw, value)
    at = F.col(order) if order else F.monotonically_increasing_id()
    get = lambda key, kind: F.expr(f"try_variant_get(v, '$.{key}', '{kind}')")
    score = get("score", "double")
    success = F.coalesce(get("success", "boolean"), score >= threshold)
    every = F.from_json(value, "map<string,variant>")
    strata = F.map_filter(every, lambda k, x: ~k.isin(*RESERVED) & F.schema_of_variant(x).rlike(f"{_TEXT}|{_NUMBER}"))
    return df.select(
        get("run_id", "string").alias("run_id"), get("model", "string").alias("model"), get("task", "string").alias("task"), F.coalesce(get("episode", "int"), F.lit(0)).alias("episode"), score.alias("score"), success.alias("success"),
        F.transform_values(strata, lambda k, x: x.cast("string")).alias("strata"), F.coalesce(get("failure_mode", "string"), F.when(~success, F.lit("below_threshold"))).alias("failure_mode"), get("length", "int").alias("length"),
        get("trajectory", "string").alias("trajectory_ref"), F.to_json(F.expr("try_variant_get(v, '$.metadata', 'variant')")).alias("meta"), at.alias("ord"), "errors",
    )


def checked(converted: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(episodes, rejected): strict makes the first invalid record raise when the episodes are computed."""
    ok = F.size("errors") == 0
    if strict:
        message = F.concat(F.lit("invalid record "), F.col("ord").cast("string"), F.lit(": "), F.array_join("errors", "; "))
        good = converted.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    else:
        good = converted.where(ok)
    return good.select(*EPISODE.names), converted.where(~ok)


def read_generic(spark: SparkSession, path: str, threshold: float = THRESHOLD, strict: bool = True, eager: bool = False) -> Episodes:
    """``.jsonl`` line by line; other files as one JSON list or ``{"records": [...]}`` each.

    ``eager`` checks the lines in a pass of its own and raises with the file and
    line of the first bad ones; else an invalid record raises when it is computed.
    """
    if path.rstrip("/").endswith(".jsonl"):
        if strict and eager and (found := bad_lines(spark, path).orderBy("file", "line").limit(10).collect()):
            raise ValueError("invalid records: " + "; ".join(f"{r['file']}, line {r['line']}: {', '.join(r['errors'])}" for r in found))
        raw = in_file_order(spark.read.text(path))
    else:
        whole = spark.read.text(path, wholetext=True)
        items = F.coalesce(F.from_json("value", "array<variant>"), F.from_json("value", "struct<records:array<variant>>")["records"])
        listed = whole.select(F.col("_metadata.file_path").alias("_file"), F.posexplode(items).alias("at", "item")).sort("_file", "at")
        raw = listed.select(F.to_json("item").alias("value"), F.monotonically_increasing_id().alias("place"))
    return Episodes(checked(convert(raw, order="place", threshold=threshold), strict)[0])


def from_dicts(spark: SparkSession, rows: list[dict], threshold: float = THRESHOLD, strict: bool = True) -> Episodes:
    raw = spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(rows)], "value string, place bigint")
    return Episodes(checked(convert(raw, order="place", threshold=threshold), strict)[0])


def validate(spark: SparkSession, rows: list[dict]) -> list[list[str]]:
    """Errors of each raw record, in order."""
    raw = spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(rows)], "value string, place bigint")
    return [r["errors"] for r in convert(raw, order="place").select("ord", "errors").orderBy("ord").collect()]


def read_rewards(spark: SparkSession, path: str) -> DataFrame:
    """Reward JSONL -> (ord, score): a number, null, or the mean of named rewards."""
    raw = in_file_order(spark.read.text(path)).withColumnRenamed("place", "ord")
    named = F.map_values(F.from_json("value", "map<string,double>"))
    mean = F.when(F.size(named) > 0, F.aggregate(named, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(F.filter(named, lambda x: x.isNotNull())))
    return raw.select("ord", F.coalesce(F.expr("try_cast(value AS double)"), mean).alias("score"))


def promote(df: DataFrame, order: str = "ord") -> DataFrame:
    """Episodes numbered within each task, in order."""
    return df.withColumn("episode", (F.row_number().over(Window.partitionBy("task").orderBy(order)) - 1).cast("int"))
