"""Operator 1: exact deduplication by content-defined chunk recipes.

1. Every text is cut into content-defined chunks on the executor that reads
   it; only ``(chunk hash, SHA-256 of the chunk)`` leaves it, never the text.
2. Chunks are deduplicated.  A 64-bit hash under which two SHA-256 digests
   meet gets one *verified identifier* ``(hash, ordinal)`` for each of them.
3. A document's recipe is its ordered list of identifiers; documents with the
   same recipe have the same text.  Recipes are compared whole, with a
   map-side partial aggregate, so a group of copies of any size is one row
   from each task.

Defined results: null text counts as empty; empty texts form one group; a
repeated row is another document (it is counted, and returned, once more); a
null ``doc_id`` never wins against another one; no rows give no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.llm.blocks import list_column, text_blocks
from episodeframe.llm.chunking import chunk_bounds
from episodeframe.llm.shared import drop_table, materialize, narrow

CHUNK_BITS, CHUNK_LEAST = 10, 256


def _recipes(bits: int, least: int):
    def run(batches):
        for block in text_blocks(batches):
            starts, ends, first = chunk_bounds(block, bits, least)
            raw = memoryview(block.data)
            parts = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), dtype=np.uint64, count=len(parts))
            checks = [hashlib.sha256(p).digest() for p in parts]
            whole = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(block.starts.tolist(), block.ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(whole, pa.string()),
                    list_column(hashes.view(np.int64), first, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(checks, pa.binary())),
                ],
                names=["doc_id", "text_sha256", "hashes", "checks"],
            )

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bits: int = CHUNK_BITS, chunk_least: int = CHUNK_LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    cut = materialize(
        source.mapInArrow(_recipes(chunk_bits, chunk_least), f"doc_id {kind}, text_sha256 string, hashes array<bigint>, checks array<binary>"),
        "recipes",
    )
    rows = cut.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"), F.first("hashes").alias("hashes"), F.first("checks").alias("checks"))
    uses = rows.select("doc_id", "text_sha256", "times", F.posexplode_outer(F.arrays_zip("hashes", "checks")).alias("pos", "chunk")).select(
        "doc_id", "text_sha256", "times", "pos", F.col("chunk.hashes").alias("hash"), F.col("chunk.checks").alias("check")
    )
    found = cut.select(F.explode(F.arrays_zip("hashes", "checks")).alias("chunk")).select(F.col("chunk.hashes").alias("hash"), F.col("chunk.checks").alias("check")).distinct()
    # Nearly always one digest a hash; the others are told apart by their order.
    known = found.groupBy("hash").agg(F.array_sort(F.collect_list("check")).alias("digests"))
    verified = known.select("hash", F.posexplode("digests").alias("ordinal", "check"))
    recipes = (
        uses.join(verified, ["hash", "check"], "left")
        .groupBy("doc_id", "text_sha256", "times")
        .agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "hash", "ordinal")))).alias("parts"))
        .select("doc_id", "text_sha256", "times", F.transform("parts", lambda p: F.struct(p["hash"].alias("hash"), p["ordinal"].alias("ordinal"))).alias("recipe"))
    )
    recipes = materialize(recipes, "joined")
    # A table of its own, so that Spark can split the tasks of a group of very many copies.
    groups = materialize(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    drop_table(cut)
    out = recipes.join(groups, "recipe").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))
