"""Nearest remembered runs for a table of queries.

Queries come in blocks of ``BLOCK`` rows, whose bags of tools are broadcast; the
records are read once a block and never shuffled.  A task compares a batch of
records with all queries of the block by one product of count matrices and keeps
the best ``k`` of each query, so what it sends on is bounded by queries times
``k``, whatever the number of records; a ranked window over these is the result.
Similarities are whole numbers over one root, rounded to 12 places, so that equal
bags tie wherever they are computed.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: queries compared at once
BLOCK = 256


class Queries:
    """A block of queries: ids, bags of tools over their common vocabulary, words of their descriptions."""

    def __init__(self, table: pa.Table, query: str) -> None:
        self.ids = table.column(query).combine_chunks()
        bags = [Counter(s or ()) for s in (table.column("tool_sequence").to_pylist() if "tool_sequence" in table.column_names else [None] * len(table))]
        tools = sorted({t for b in bags for t in b})
        self.place = {t: i for i, t in enumerate(tools)}
        self.counts = np.array([[b.get(t, 0) for t in tools] for b in bags], dtype=np.float64).reshape(len(bags), len(tools))
        self.square = np.square(self.counts).sum(axis=1)
        texts = table.column("description").to_pylist() if "description" in table.column_names else [None] * len(table)
        self.words = [list(dict.fromkeys(re.findall("[a-z0-9]+", (t or "").lower()))) for t in texts]
        self.outcomes = table.column("outcome").to_pylist() if "outcome" in table.column_names else [None] * len(table)

    def dots(self, sequences: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(dot products, squared lengths of the records) of a batch of records."""
        owner = np.repeat(np.arange(len(sequences)), np.diff(sequences.offsets.to_numpy()))
        flat = sequences.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
        keys, n = np.unique(owner * max(1, len(names)) + codes, return_counts=True)
        rows, kinds = np.divmod(keys, max(1, len(names)))
        square = np.bincount(rows, weights=n.astype(np.float64) ** 2, minlength=len(sequences))
        column = np.array([self.place.get(t, -1) for t in names], dtype=np.int64)
        known = column[kinds] >= 0 if len(names) else np.zeros(0, bool)
        bags = np.zeros((len(sequences), len(self.place)))
        bags[rows[known], column[kinds[known]]] = n[known]
        return bags @ self.counts.T, square

    def cosines(self, sequences: pa.ListArray) -> np.ndarray:
        dots, square = self.dots(sequences)
        scale = np.sqrt(square[:, None] * self.square[None, :])
        return np.round(np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0), 12)

    def matches(self, paths: list[str | None]) -> np.ndarray:
        """Share of a query's words that a record's path holds."""
        different = {p: i for i, p in enumerate(dict.fromkeys(paths))}
        lower = [(p or "").lower() for p in different]
        share = np.array([[sum(w in p for w in words) / len(words) if words else 0.0 for words in self.words] for p in lower])
        return share.reshape(len(lower), len(self.words))[[different[p] for p in paths]]


class Best:
    """The first ``k`` rows of a query in the order of their keys (least first)."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def add(self, first: np.ndarray, places: np.ndarray, row) -> None:
        """Rows at ``places``, whose leading key is ``first``; ``row(i)`` is the whole key and what goes with it."""
        if len(places) > self.k:
            edge = np.partition(first, self.k - 1)[self.k - 1]
            keep = first <= edge
            first, places = first[keep], places[keep]
        if len(self.rows) == self.k:
            places = places[first <= self.rows[-1][0][0]]
        self.rows = sorted([*self.rows, *(row(i) for i in places.tolist())], key=lambda r: r[0])[: self.k]


def _blocks(queries: DataFrame, query: str, block: int):
    n = -(-queries.count() // block)
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64(F.col(query).cast("string")), F.lit(n)) == b)
        yield Queries(part.toArrow(), query)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def most_similar(queries: DataFrame, records: DataFrame, k: int = 3, query: str = "query_id", trial: str = "trial_id", block: int = BLOCK) -> DataFrame:
    """For each query the ``k`` records of either outcome with the largest cosine; ties by lower score, then id.

    ``queries`` has (query, tool_sequence); records that share no tool are no
    neighbours.  Rows without id, score or sequence take no part.
    """
    asked = queries.select(query, "tool_sequence").where(F.col(query).isNotNull() & F.col("tool_sequence").isNotNull())
    rows = records.select(trial, "score", "tool_sequence").where(F.col(trial).isNotNull() & F.col("score").isNotNull() & F.col("tool_sequence").isNotNull())
    names = [query, trial, "similarity", "score", "outcome"]
    schema = f"`{query}` {_kind(queries, query)}, `{trial}` {_kind(records, trial)}, similarity double, score double, outcome string"

    def scan(shared):
        def run(batches):
            q, best, kind = shared.value, {}, None
            for batch in batches:
                kind = batch.schema.field(trial).type
                ids, scores = batch.column(trial).to_pylist(), batch.column("score").to_numpy(zero_copy_only=False).astype(float)
                cosine = q.cosines(batch.column("tool_sequence"))
                for outcome, side in (("high", scores >= 0.5), ("low", ~(scores >= 0.5))):
                    for j in range(len(q.ids)):
                        places = np.flatnonzero(side & (cosine[:, j] > 0))
                        if len(places):
                            row = lambda i, j=j: ((-float(cosine[i, j]), float(scores[i]), ids[i]),)
                            best.setdefault((j, outcome), Best(k)).add(-cosine[places, j], places, row)
            found = [(j, outcome, *r[0]) for (j, outcome), b in best.items() for r in b.rows]
            if found:
                columns = [q.ids.take(pa.array([f[0] for f in found])), pa.array([f[4] for f in found], kind), pa.array([-f[2] for f in found]), pa.array([f[3] for f in found]), pa.array([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    context = records.sparkSession.sparkContext
    frames = [rows.mapInArrow(scan(context.broadcast(b)), schema) for b in _blocks(asked, query, block)]
    if not frames:
        return records.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy(query, "outcome").orderBy(F.desc("similarity"), "score", trial)
    return _union(frames).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve_many(records: DataFrame, queries: DataFrame, k: int = 5, query: str = "query_id", trial: str = "trial_id", block: int = BLOCK) -> DataFrame:
    """The best ``k`` memories of every query: 0.7 cosine + 0.3 keyword match, times 1.3 for recoverable highs.

    ``queries`` has (query, description) and may have tool_sequence and outcome
    (a class of records that alone may be taken).  ``records`` are those of
    ``trajectory.recoverable_highs``.  Ties by higher score, recoverable ones
    first, then id.
    """
    asked = queries.select(query, *(c for c in ("description", "tool_sequence", "outcome") if c in queries.columns)).where(F.col(query).isNotNull())
    rows = records.where(F.col(trial).isNotNull() & F.col("score").isNotNull()).select(trial, "score", "task_path", F.coalesce("tool_sequence", F.array().cast("array<string>")).alias("tool_sequence"), "outcome_class", "is_recoverable_high")
    names = [query, trial, "similarity", "task_match", "final_score"]
    schema = f"`{query}` {_kind(queries, query)}, `{trial}` {_kind(records, trial)}, similarity double, task_match double, final_score double, _score double, _recoverable boolean"

    def scan(shared):
        def run(batches):
            q, best, kind = shared.value, {}, None
            for batch in batches:
                kind = batch.schema.field(trial).type
                ids, scores = batch.column(trial).to_pylist(), batch.column("score").to_numpy(zero_copy_only=False).astype(float)
                classes, again = np.array(batch.column("outcome_class").to_pylist(), dtype=object), np.array([bool(x) for x in batch.column("is_recoverable_high").to_pylist()])
                cosine, match = q.cosines(batch.column("tool_sequence")), q.matches(batch.column("task_path").to_pylist())
                final = np.round((0.7 * cosine + 0.3 * match) * np.where(again, 1.3, 1.0)[:, None], 12)
                for j, outcome in enumerate(q.outcomes):
                    places = np.arange(len(ids)) if outcome is None else np.flatnonzero(classes == outcome)
                    if len(places):
                        row = lambda i, j=j: ((-float(final[i, j]), -float(scores[i]), not again[i], ids[i]), float(cosine[i, j]), float(match[i, j]))
                        best.setdefault(j, Best(k)).add(-final[places, j], places, row)
            found = [(j, *r) for j, b in best.items() for r in b.rows]
            if found:
                columns = [q.ids.take(pa.array([f[0] for f in found])), pa.array([f[1][3] for f in found], kind), pa.array([f[2] for f in found]), pa.array([f[3] for f in found]), pa.array([-f[1][0] for f in found]), pa.array([-f[1][1] for f in found]), pa.array([not f[1][2] for f in found])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_score", "_recoverable"])

        return run

    context = records.sparkSession.sparkContext
    frames = [rows.mapInArrow(scan(context.broadcast(b)), schema) for b in _blocks(asked, query, block)]
    if not frames:
        return records.sparkSession.createDataFrame([], schema + ", rank int").drop("_score", "_recoverable")
    w = Window.partitionBy(query).orderBy(F.desc("final_score"), F.desc("_score"), F.desc("_recoverable"), trial)
    return _union(frames).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_score", "_recoverable")


def with_similar(checked: DataFrame, records: DataFrame, k: int = 3, query: str = "query_id", trial: str = "trial_id") -> DataFrame:
    """Checked runs (``trajectory.check``) with ``similar_high`` and ``similar_low``: ``k`` records each, nearest first."""
    near = most_similar(checked, records, k, query, trial)
    entry = F.struct("rank", F.col(trial).alias("trial_id"), "similarity", "score")
    # k entries a side at most.
    side = lambda o: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, entry))).alias(f"similar_{o}")
    lists = near.groupBy(query).agg(side("high"), side("low"))
    none = F.array().cast("array<struct<rank:int,trial_id:" + _kind(records, trial) + ",similarity:double,score:double>>")
    return checked.join(lists, query, "left").withColumns({f"similar_{o}": F.coalesce(f"similar_{o}", none) for o in ("high", "low")})
