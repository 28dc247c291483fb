"""A corpus cleaning run: each stage applies one training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last give
back the columns of ``docs``.  Rows with null or empty text have no language
and go in the first stage; a repeated row goes in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeframe.llm import bpe, decontaminate, exact_dedup, jaccard_join, langid
from episodeframe.llm.shared import materialize

#: No SQL: language ID, near duplicates and byte-level BPE can't be expressed.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressor can tell stay."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return langid.identified(docs, langid.learn_dictionaries(docs.where(fold != 2)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once."""
    # One string key for both the join and the repeated rows: the texts are dealt once.
    pair = lambda i, sha: F.concat_ws(":", sha, F.coalesce(i.cast("string"), F.lit("-")))
    key = "pair_key"
    while key in docs.columns:
        key += "_"
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(pair(F.col("doc_id"), F.col("text_sha256")).alias(key)).distinct()
    keyed = docs.withColumn(key, pair(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    stay = keyed.join(kept, key, "left_semi").dropDuplicates([key])
    return stay.select(*(F.col(f"`{c}`") for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document that names it stays."""
    found = jaccard_join.similar_components(docs)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, with the check of their decoding."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", without_benchmark), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
