"""Operator 4: substring deduplication over content-defined chunks.

A gear rolling hash cuts every text into chunks of about 32 bytes; a cut
depends on the 32 bytes before it only, so a passage pasted anywhere falls
into the same chunks apart from its edges.  Chunks are deduplicated by digest
with a partial aggregate; the digests that occur again are joined back, and
neighbouring repeated chunks make up runs.  A run counts from ``least`` bytes
on: single small chunks repeat by chance.  In a run every chunk but the
digest's first occurrence (smallest doc_id, then smallest hash of the text,
then first in the text) goes; a first occurrence outside any counted run
stays as well, and so none in a run does.  Digests are 128 bits of BLAKE2b.

Defined results: null text counts as empty and has no chunks; of rows with the
same id and text each gets the result of one, and their chunks count as
repeated; rows with equal ids and other texts are different documents; a chunk
may be as long as its text, whatever the length; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.llm.blocks import list_column, text_blocks
from episodeframe.llm.chunking import chunk_bounds
from episodeframe.llm.shared import bounded_batches, materialize

CHUNK_BITS, CHUNK_LEAST, RUN_LEAST, DIGEST_BYTES = 5, 8, 80, 16

SPANS = "array<struct<begin:bigint,finish:bigint>>"


def _chunks(bits: int, least: int):
    def run(batches):
        for block in text_blocks(batches):
            starts, ends, first = chunk_bounds(block, bits, least)
            raw = memoryview(block.data)
            digests = pa.array([hashlib.blake2b(raw[s:e], digest_size=DIGEST_BYTES).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            local = starts - np.repeat(block.starts, np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    block.column("text_key"),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), digests),
                    list_column(local, first, pa.int64()),
                    list_column(ends - starts, first, pa.int64()),
                ],
                names=["doc_id", "text_key", "digests", "places", "sizes"],
            )

    return run


def _spans(least: int):
    """Per document: its repeated chunks in order -> counted runs and what goes."""

    def run(batches):
        for batch in batches:
            removed, repeated = [], []
            for chunks in batch.column(2).to_pylist():
                runs: list[list] = []
                first: dict[bytes, int] = {}
                for c in sorted(chunks, key=lambda c: c["place"]):
                    begin = c["place"]
                    # The first place of a digest stays, in a counted run or not.
                    stays = c["is_first"] and first.setdefault(c["digest"], begin) == begin
                    item = (begin, begin + c["size"], stays)
                    if runs and runs[-1][-1][1] == begin:
                        runs[-1].append(item)
                    elif not (runs and runs[-1][-1][0] == begin):
                        runs.append([item])
                runs = [r for r in runs if r[-1][1] - r[0][0] >= least]
                repeated.append([{"begin": r[0][0], "finish": r[-1][1]} for r in runs])
                out = []
                for begin, finish, stays in (c for r in runs for c in r):
                    if stays:
                        continue
                    if out and out[-1]["finish"] == begin:
                        out[-1]["finish"] = finish
                    else:
                        out.append({"begin": begin, "finish": finish})
                removed.append(out)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(repeated, kind), pa.array(removed, kind)], names=["doc_id", "text_key", "repeated", "removed"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = CHUNK_BITS, chunk_least: int = CHUNK_LEAST, run_least: int = RUN_LEAST) -> DataFrame:
    """doc_id, n_bytes, n_repeated, n_removed, has_repeat, repeated and removed byte spans."""
    bounded_batches(docs)
    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    cut = source.mapInArrow(_chunks(bits, chunk_least), f"doc_id {kind}, text_key bigint, digests array<binary>, places array<bigint>, sizes array<bigint>")
    document = F.struct("doc_id", "text_key")
    again = cut.select(document.alias("document"), F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min("document").alias("first")).where("times > 1")
    # A table of its own, so that Spark can split the tasks of a chunk that is everywhere.
    again = materialize(again.select("digest", "first"), "again")
    uses = cut.select("doc_id", "text_key", F.explode(F.arrays_zip("digests", "places", "sizes")).alias("c")).select("doc_id", "text_key", F.col("c.digests").alias("digest"), F.col("c.places").alias("place"), F.col("c.sizes").alias("size"))
    found = (
        uses.join(again, "digest")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("place", "size", "digest", document.eqNullSafe(F.col("first")).alias("is_first"))).alias("chunks"))
        .mapInArrow(_spans(run_least), f"doc_id {kind}, text_key bigint, repeated {SPANS}, removed {SPANS}")
        .withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    )
    base = source.select("doc_id", "text_key", F.octet_length("text").cast("bigint").alias("n_bytes"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    none = F.array().cast(SPANS)
    joined = joined.select("doc_id", "n_bytes", F.coalesce("repeated", none).alias("repeated"), F.coalesce("removed", none).alias("removed"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, s: a + s["finish"] - s["begin"])
    return joined.select("doc_id", "n_bytes", total("repeated").alias("n_repeated"), total("removed").alias("n_removed"), (F.size("repeated") > 0).alias("has_repeat"), "repeated", "removed")
