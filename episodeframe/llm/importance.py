"""Operator 12: resampling towards a target distribution by importance weights.

The features of a text are its runs of 1 to ``grams`` words; each has a bucket,
the CRC-32 of its bytes modulo ``buckets``.  A task keeps a *trie* of words: a
path from the root is a run of words, and its node holds how often the run came
and the CRC state after it, so a longer run costs the CRC of its last word only.
When the trie has ``MOST_NODES`` nodes, or the task ends, its counts are added to
the task's bucket totals.  Merged totals of the documents and of the target give
every bucket its gain, a list as long as the number of buckets, which is
broadcast; documents are then scored by walking such tries again, with the gain
attached to a node when it is made.

The highest scores with Gumbel noise are drawn.  Their ranks come from ranges of
scores and the counts before each range (``operators.scans``), so no task sees
all rows.

Defined results: a null text has no words and weight 0; a text of any length is
walked whole; a null id is written as an empty string in its hash and comes
first among ties; repeated rows are rows of their own and get ranks of their own;
equal scores and ids go by fewer features, then lower weight; with no target text
every t is 0; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.lineage import cut
from episodeframe.llm.shared import bounded_batches
from episodeframe.operators import scans

BUCKETS, GRAMS, LEAST_WORDS, SEED = 10_000, 1, 20, 2024
PERCENT = 10
#: nodes of a trie before it is emptied
MOST_NODES = 1 << 18

#: everything of ASCII but letters and digits parts words
_PARTS = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PARTS).split(b" ") if text else []


class Node:
    """A run of words: its CRC state, its count, the gain of its bucket, and the runs that go on from it."""

    __slots__ = ("count", "crc", "gain", "next")

    def __init__(self, crc: int, gain: int = 0) -> None:
        self.crc, self.count, self.gain = crc, 0, gain
        self.next: dict[bytes, Node] = {}


class Trie:
    def __init__(self, grams: int, buckets: int, gains: list[int] | None = None, most: int = MOST_NODES) -> None:
        self.grams, self.buckets, self.gains, self.most = grams, buckets, gains, most
        self.totals = np.zeros(buckets, dtype=np.int64)
        self.root, self.nodes = Node(0), 0

    def _grow(self, parent: Node, word: bytes) -> Node:
        crc = zlib.crc32(word if parent is self.root else b" " + word, parent.crc)
        node = parent.next[word] = Node(crc, self.gains[crc % self.buckets] if self.gains else 0)
        self.nodes += 1
        return node

    def walk(self, text: str | None) -> tuple[int, int, int]:
        """(words, features, sum of their gains) of a text; every node passed counts once more."""
        row = [w for w in words(text) if w]
        features = total = 0
        for start in range(len(row)):
            node = self.root
            for word in row[start : start + self.grams]:
                node = node.next.get(word) or self._grow(node, word)
                node.count += 1
                total += node.gain
                features += 1
            if self.nodes >= self.most:
                self.flush()
        return len(row), features, total

    def flush(self) -> None:
        """Empty the trie into the bucket totals."""
        todo = list(self.root.next.values())
        while todo:
            node = todo.pop()
            self.totals[node.crc % self.buckets] += node.count
            todo.extend(node.next.values())
        self.root, self.nodes = Node(0), 0


def _count(grams: int, buckets: int, most: int):
    """One row for each bucket met by a task."""

    def run(batches):
        trie = Trie(grams, buckets, most=most)
        for batch in batches:
            for text in batch.column(0):
                trie.walk(text.as_py())
        trie.flush()
        met = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(trie.totals[met], pa.int64())], names=["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, most: int = MOST_NODES) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket met."""
    counted = texts.select(text_col).mapInArrow(_count(grams, buckets, most), "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * log of the smoothed ratio of shares) of every bucket, in doubles."""
    all_source, all_target = float(sum(source.values())), float(sum(target.values()))
    return [math.floor(1000.0 * math.log((target.get(b, 0) + 1.0) * (all_source + buckets) / ((source.get(b, 0) + 1.0) * (all_target + buckets)))) for b in range(buckets)]


def _score(gains, grams: int, buckets: int, most: int):
    def run(batches):
        trie = Trie(grams, buckets, gains.value, most)
        for batch in batches:
            rows = [trie.walk(text.as_py()) for text in batch.column("text")]
            # Floors go down for negative sums too.
            weights = [total // n if n else 0 for _, n, total in rows]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, most: int = MOST_NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of every document's features."""
    bounded_batches(docs)
    counted = [{r["bucket"]: r["n"] for r in bucket_totals(t, c, grams, buckets, most).collect()} for t, c in ((docs, text_col), (target, target_col))]
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(*counted, buckets))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(gains, grams, buckets, most), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, most: int = MOST_NODES) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the documents with enough words the best ``percent`` of 100 have a rank."""
    weighed = weights(docs, target, id_col, text_col, target_col, grams, buckets, most)
    text_id = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text_id, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("bigint").alias("score"), (F.col("n_words") >= least_words).alias("_may"))
    # Cut first: Spark samples the scores before it deals them, and would walk all texts twice.
    placed = scans.row_numbers(cut(scored), [F.desc("_may"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")], "_place_of_all")
    # Those that may be drawn come first, so their places are the ranks; how many they are is one row.
    drawn = placed.where("_may").count() * percent // 100
    rank = F.when(F.col("_may") & (F.col("_place_of_all") <= drawn), F.col("_place_of_all"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
