"""Operator 11: exact top-k search by columnar branch and bound.

Vectors are quantised to whole numbers, ``floor(SCALE * x)``, and compared by
inner product.  Candidates lie in *tiles* in vertical layout, one row of memory
for each dimension.  A query adds up its products block of dimensions by block;
by Cauchy-Schwarz the dimensions still to come add at most the product of both
remaining masses, so a candidate whose sum and bound stay below the k-th best
*lower* bound so far can't be among the k best and is compacted away.  What is
left after the last block has its exact score.

Spark deals the work: tiles and blocks of queries are rows of packed bytes.
Every tile goes to one slot, every query block to all slots, and within a slot
the blocks of queries come one after the other over all tiles of the slot, so
the k best so far of one block are all that a task remembers.  Each slot gives k
rows a query at most, and a ranked window over these makes the result.  Nothing
passes through the driver but counts.

Defined results: a null vector or id, or a null or non-finite component, keeps
a row out altogether; vectors are compared with those of their own length only;
an empty vector has score 0 with other empty ones; a query is never matched with
rows of its own id; a repeated id is one query (its least vector) but as many
candidates; ties go to the smaller id, repeated ids fill several ranks; a query
without any candidate has no rows; no rows give no rows; other columns are
ignored.  A score that may leave 64 bits is refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodeframe.llm.shared import bounded_batches

SCALE, TOP = 256, 5
#: dimensions added up between two bounds
STEP = 8
#: bytes of a tile, queries of a block, tiles of a slot at most: they steer memory, not results
TILE_BYTES, BLOCK_QUERIES, SLOT_TILES = 1 << 20, 512, 128
#: quantised components stay below this
MOST = 1 << 31

_PACKED = "size int, ids binary, body binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of rows that take part, as doubles."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~odd)


# ------------------------------------------------------------------ packing
def _matrices(batches, scale: float, tile_bytes: int, most_rows: int):
    """(ids, matrix of dimensions by rows) in the order read; vectors of one length share a matrix."""
    held: dict[int, tuple[list, list, int]] = {}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("vector")
        offsets = lists.offsets.to_numpy()
        values = np.floor(lists.values.to_numpy(zero_copy_only=False) * scale)
        sizes = np.diff(offsets)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            body = values[offsets[rows][:, None] + np.arange(size)]
            if body.size and np.abs(body).max() >= MOST:
                raise ArithmeticError(f"a component times {scale} does not fit into 32 bits")
            at_once = max(1, min(most_rows, tile_bytes // max(4, 4 * size)))
            a, b, n = held.pop(size, ([], [], 0))
            for start in range(0, len(rows), at_once):
                part = slice(start, start + at_once)
                if n and n + len(rows[part]) > at_once:
                    yield np.concatenate(a), np.concatenate(b)
                    a, b, n = [], [], 0
                a, b, n = [*a, ids[rows[part]]], [*b, body[part].astype(np.int32)], n + len(rows[part])
            held[size] = (a, b, n)
    for a, b, _ in held.values():
        yield np.concatenate(a), np.concatenate(b)


def _pack(scale: float, tile_bytes: int, most_rows: int, upright: bool):
    """``upright``: one row of memory a dimension (tiles), else a vector (queries)."""

    def run(batches):
        for ids, body in _matrices(batches, scale, tile_bytes, most_rows):
            laid = np.ascontiguousarray(body.T) if upright else body
            yield pa.RecordBatch.from_arrays(
                [pa.array([body.shape[1]], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([laid.tobytes()], pa.binary())],
                names=["size", "ids", "body"],
            )

    return run


# ---------------------------------------------------------------- searching
class Tile:
    """Candidates in vertical layout, dimensions of most mass first, with the masses that remain before each block."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, step: int = STEP) -> None:
        self.ids, self.step, self.size = ids, step, len(columns)
        whole = columns.astype(np.float64)
        mass = np.einsum("ij,ij->i", whole, whole)
        self.order = np.argsort(-mass, kind="stable")
        self.columns = whole[self.order]
        self.cuts = [*range(0, self.size, step), self.size] if self.size else [0]
        # The root of the mass from each cut on, rounded up.
        square = np.add.accumulate(np.square(self.columns[::-1]), axis=0)[::-1] if self.size else np.zeros((0, len(ids)))
        self.rest = [np.sqrt(square[c]) * (1 + 1e-12) if c < self.size else np.zeros(len(ids)) for c in self.cuts]
        self.most = float(self.rest[0].max()) if len(ids) else 0.0


def query_rest(query: np.ndarray, cuts: list[int]) -> list[float]:
    return [float(np.sqrt(np.square(query[c:]).sum())) * (1 + 1e-12) for c in cuts]


def search(tile: Tile, query: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of the tile's candidates that can be among the k best and reach ``least``."""
    query = query[tile.order].astype(np.float64)
    rest = query_rest(query, tile.cuts)
    if tile.most * rest[0] >= 2.0**53:
        return exact(tile, query, own)
    live = np.flatnonzero(tile.ids != own)
    total = np.zeros(len(live))
    whole = len(live) == len(tile.ids)
    for nth in range(len(tile.cuts) - 1):
        lo, hi = tile.cuts[nth], tile.cuts[nth + 1]
        block = tile.columns[lo:hi]
        total += query[lo:hi] @ (block if whole else block.take(live, axis=1))
        bound = tile.rest[nth + 1].take(live) * rest[nth + 1]
        if len(live) > k:
            sure = total - bound
            least = max(least, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
        stay = total + bound >= least - 0.5
        if not stay.all():
            live, total, whole = live[stay], total[stay], False
    return total.astype(np.int64), live


def exact(tile: Tile, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers beyond the reach of doubles: all candidates, in 64 bits."""
    if tile.most * query_rest(query, [0])[0] >= 2.0**63:
        raise ArithmeticError("an inner product may not fit into 64 bits")
    live = np.flatnonzero(tile.ids != own)
    return query.astype(np.int64) @ tile.columns[:, live].astype(np.int64), live


class Best:
    """The k best of one query so far, ties to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def _search(k: int, step: int):
    """Rows (query block, tile), tiles of one block together -> the best of each query among them."""

    def found(queries, best):
        at = np.repeat(np.arange(len(queries)), [len(b.scores) for b in best])
        return pa.RecordBatch.from_arrays(
            [pa.array(queries[at], pa.int64()), pa.array(np.concatenate([b.ids for b in best]), pa.int64()), pa.array(np.concatenate([b.scores for b in best]), pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches):
        last, queries, vectors, best = None, None, None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("size", "query_ids", "query_body", "tile_size", "ids", "body")]
            for size, query_ids, query_body, tile_size, ids, body in zip(*columns, strict=True):
                size, key = size.as_py(), (size.as_py(), query_ids.as_py())
                if tile_size.as_py() != size:
                    continue
                if key != last:
                    if best:
                        yield found(queries, best)
                    last, queries = key, np.frombuffer(key[1], np.int64)
                    vectors = np.frombuffer(query_body.as_py(), np.int32).reshape(len(queries), size)
                    best = [Best(k) for _ in queries]
                names = np.frombuffer(ids.as_py(), np.int64)
                tile = Tile(names, np.frombuffer(body.as_py(), np.int32).reshape(size, len(names)), step)
                for own, query, b in zip(queries.tolist(), vectors, best, strict=True):
                    scores, places = search(tile, query, own, k, b.least)
                    b.add(scores, names[places])
        if best:
            yield found(queries, best)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", step: int = STEP, tile_bytes: int = TILE_BYTES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best inner products of each query with all other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    bounded_batches(vectors)
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = rows.where(is_query)
    total, queries, size = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("vector"))).first()
    per_tile = max(1, tile_bytes // max(4, 4 * (size or 1)))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (per_tile * SLOT_TILES)))
    tiles = rows.mapInArrow(_pack(scale, tile_bytes, 1 << 30, upright=True), _PACKED)
    # By content, so that a task that is run again deals the same tile to the same slot.
    tiles = tiles.withColumnRenamed("size", "tile_size").withColumn("slot", F.pmod(F.xxhash64("ids", "body"), F.lit(slots)).cast("int"))
    one = asked.repartition(max(1, -(-queries // block_queries)), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = one.mapInArrow(_pack(scale, 1 << 30, block_queries, upright=False), _PACKED)
    blocks = blocks.withColumnsRenamed({"ids": "query_ids", "body": "query_body"}).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # Blocks of queries stream past the tiles of their slot, which Spark buffers.
    # A task for each slot: the work grows with pairs, not with bytes, by which Spark would unite them.
    pairs = blocks.repartition(slots, "slot").hint("merge").join(tiles.repartition(slots, "slot"), "slot")
    best = pairs.select("size", "query_ids", "query_body", "tile_size", "ids", "body").mapInArrow(_search(k, step), _FOUND)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
