"""Operator 10: exact removal of repeated 200-byte strings by suffix arrays.

A byte goes if some ``LENGTH``-byte string over it starts anywhere else too.
Which strings repeat is decided by two-stage suffix sorting and adjacent common
prefixes alone.  All suffixes of a large corpus can't be sorted at once, so the
work is dealt out in such a way that equal strings always meet:

1. Every text is stored once, where it was read (``RowStore``).  Equal texts
   have the same verdict, so one of them takes part, counted twice if it has
   copies: that is all that repetition asks for.
2. Among the ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes of a window the least
   hash is its *anchor*.  Equal windows have equal anchors, so a window can only
   repeat if its anchor stands at two places: in two pieces (below), or twice
   in one.  Both kinds count as two uses, and all that has one use is left out.
3. Neighbouring windows of one anchor make up a *piece* of text (a longer run is
   cut after ``MOST_WINDOWS``).  Pieces are named by (anchor, BLAKE2b of the
   bytes); of equal pieces one goes on, twice if there are several.
4. Anchors whose pieces are more than ``SORT_BYTES`` (the edges of a passage that
   is in very many texts) are split: windows with a common core of ``m`` bytes
   lack ``need = LENGTH - m``; one that has at least half of them to the left is
   dealt by the core lengthened to the left, the others by the core lengthened
   to the right.  After at most nine rounds a core is a whole window and what
   bears one name is one string, so no task gets more than a bounded group.
5. Each task suffix-sorts its pieces; common prefixes of ``LENGTH`` bytes mark
   the windows that repeat, and the ranges go back to the texts by (part, row).

Defined results: null text counts as empty; matches don't cross documents;
overlapping occurrences count; a repeated row is another document, so its text
repeats; texts shorter than ``LENGTH`` lose nothing; texts of any length are
worked on in stretches; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.lineage import cut as checkpointed
from episodeframe.llm.blocks import Block, list_column, prefix_hash, span_hash, text_blocks
from episodeframe.llm.shared import RowStore, drop_table, materialize, narrow, restored
from episodeframe.llm.suffix_sort import common_to, suffix_array

LENGTH, GRAM = 200, 64
#: bytes suffix-sorted at once; windows of a piece; bytes whose grams are hashed at once
SORT_BYTES, MOST_WINDOWS, STRETCH = 1 << 20, 512, 1 << 19

RANGES = "array<struct<begin:int,finish:int>>"
_RANGES = pa.list_(pa.struct([("begin", pa.int32()), ("finish", pa.int32())]))
SPANS = "array<struct<begin:bigint,finish:bigint>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))


# ---------------------------------------------------------------- anchors
def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def standing_twice(grams: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """For runs of windows: whether the anchor's hash stands at two or more places of the run's grams.

    Anchors are minima, so few grams come up to the greatest of them, and only these are looked up.
    """
    places = np.flatnonzero(grams <= anchor.max())
    known, code = np.unique(anchor, return_inverse=True)
    values = grams[places]
    of = np.searchsorted(known, values)
    met = known[of] == values
    reach = np.int64(len(grams) + 1)
    keys = np.sort(of[met] * reach + places[met])
    return np.searchsorted(keys, code * reach + high + width - 1, side="right") - np.searchsorted(keys, code * reach + low, side="left") > 1


def anchors_of(block: Block, length: int, gram: int, most: int = MOST_WINDOWS, looped: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, anchor) in block order: runs of window starts with one anchor, of ``most`` at most.

    ``looped`` gets, for each array of runs, whether their anchors stand twice.
    """
    n = len(block.data)
    inside = np.zeros(n + 1, dtype=np.int8)
    whole = block.ends - block.starts >= length
    inside[block.starts[whole]] += 1
    np.add.at(inside, block.ends[whole] - length + 1, -1)
    lows, highs, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    held = 0
    for at in range(0, max(0, n - length + 1), STRETCH):
        data = block.data[at : at + STRETCH + length - 1]
        grams = np.arange(len(data) - gram + 1, dtype=np.int64)
        hashes = span_hash(prefix_hash(data), grams, grams + gram)
        least = sliding_least(hashes, length - gram + 1)
        state = held + np.cumsum(inside[at : at + len(least)], dtype=np.int64)
        held = int(state[-1])
        windows = np.flatnonzero(state)
        if not len(windows):
            continue
        value = least[windows]
        change = np.flatnonzero((np.diff(windows) != 1) | (value[1:] != value[:-1])) + 1
        low, high = windows[np.append(0, change)], windows[np.append(change - 1, len(windows) - 1)]
        anchor = value[np.append(0, change)]
        times = (high - low) // most + 1
        if times.max() > 1:
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            high, anchor = np.repeat(high, times), np.repeat(anchor, times)
            low = np.repeat(low, times) + nth * most
            high = np.minimum(high, low + most - 1)
        if looped is not None:
            looped.append(standing_twice(hashes, low, high, anchor, length - gram + 1))
        lows.append(low + at)
        highs.append(high + at)
        anchors.append(anchor)
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(anchors)


def _scan(length: int, gram: int):
    def run(batches):
        for block in text_blocks(batches):
            twice: list[np.ndarray] = [np.zeros(0, bool)]
            low, _, anchors = anchors_of(block, length, gram, looped=twice)
            first = np.append(np.searchsorted(low, block.starts, side="left"), len(low))
            # An empty text shares its start with the next one and has no anchor.
            looped = np.concatenate(twice)
            loops = np.append(0, np.cumsum(looped))[first]
            lists = [list_column(anchors.view(np.int64), first, pa.int64()), list_column(anchors[looped].view(np.int64), loops, pa.int64())]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_key"), block.column("text"), *lists], names=["doc_id", "text_key", "text", "anchors", "looped"])

    return run


# ----------------------------------------------------------------- pieces
def _pieces(length: int, gram: int):
    """Texts with their shared anchors (as ordinals) -> pieces."""

    def run(batches):
        for block in text_blocks(batches):
            low, high, anchors = anchors_of(block, length, gram)
            first = np.append(np.searchsorted(low, block.starts, side="left"), len(low))
            column = block.column("shared")
            lists = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(column.offsets.to_numpy())
            doc = np.repeat(np.arange(len(block)), sizes)
            which = first[doc] + lists
            raw = block.data.tobytes()
            bodies = [raw[a : b + length] for a, b in zip(low[which].tolist(), high[which].tolist(), strict=True)]
            rows, times = (block.column(c).to_numpy(zero_copy_only=False) for c in ("row", "times"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[doc], pa.int64()),
                    pa.array(low[which] - block.starts[doc], pa.int64()),
                    pa.array(times[doc], pa.int64()),
                    pa.array(anchors[which].view(np.int64), pa.int64()),
                    pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in bodies], pa.binary()),
                    pa.array(bodies, pa.binary()),
                ],
                names=["row", "begin", "times", "anchor", "piece", "body"],
            )

    return run


def cores(body: bytes, length: int, core: bytes) -> list[tuple[int, int, int]]:
    """(first window, last window, place of the core in the body) for the leftmost core of every window."""
    out, window, last = [], 0, len(body) - length
    while window <= last:
        at = body.find(core, window, window + length)
        if at < 0:
            window += 1
            continue
        upto = min(at, last)
        out.append((window, upto, at))
        window = upto + 1
    return out


def halves(low: int, high: int, at: int, size: int, length: int) -> list[tuple[int, int, int, int]]:
    """Windows ``low..high`` over a core -> (low, high, begin and size of the longer core) of both halves."""
    need = length - size
    left = -(-need // 2)
    right = need - left + 1
    out = []
    # A window that starts at i has at - i bytes before the core.
    if low <= min(high, at - left):
        out.append((low, min(high, at - left), at - left, size + left))
    if max(low, at - left + 1) <= high:
        out.append((max(low, at - left + 1), high, at, size + right))
    return out


def _split(length: int):
    """Pieces of a large group -> narrower pieces that have longer cores."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for anchor, piece, offset, times, core_at, core_size, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "piece", "offset", "times", "core_at", "core_size", "body")), strict=True):
                if core_size < 0:
                    # The piece's own anchor gram, wherever it stands in each window.
                    data = np.frombuffer(body, np.uint8)
                    grams = np.arange(len(data) + core_size + 1)
                    hashes = span_hash(prefix_hash(data), grams, grams - core_size)
                    at = int(np.flatnonzero(hashes.view(np.int64) == anchor)[0])
                    parts = cores(body, length, body[at : at - core_size])
                    size = -core_size
                else:
                    parts, size = [(0, len(body) - length, core_at)], core_size
                for low, high, at in parts:
                    for a, b, begin, wide in halves(low, high, at, size, length):
                        part = body[a : b + length]
                        key = xxhash.xxh3_64_intdigest(body[begin : begin + wide], seed=begin != at) - (1 << 63)
                        rows.append((anchor, piece, offset + a, times, begin - a, wide, key, hashlib.blake2b(part, digest_size=16).digest(), part))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            names = ["anchor", "piece", "offset", "times", "core_at", "core_size", "key", "name", "body"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


_SPLIT = "anchor bigint, piece binary, offset bigint, times bigint, core_at int, core_size int, key bigint, name binary, body binary"


# ---------------------------------------------------------------- sorting
def repeated_windows(bodies: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each body the ranges of window starts that occur twice among all bodies."""
    # No UTF-8 text has byte 0xFF, so no common prefix crosses it.
    text = np.frombuffer(b"\xff".join([*bodies, b""]), dtype=np.uint8)
    order = suffix_array(text, length)
    again = common_to(text, order, length)
    marked = np.zeros(len(text) + 1, dtype=bool)
    marked[order[again]] = True
    marked[order[np.flatnonzero(again) - 1]] = True
    # A prefix that takes in a separator is no window; windows of two bodies never touch.
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.zeros(len(text) + 1, dtype=np.int8)
    inside[starts] = 1
    inside[starts + sizes - length + 1] = -1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked & (np.cumsum(inside, dtype=np.int8) > 0), [False]])))
    begin, finish = edge[::2], edge[1::2]
    cuts = np.searchsorted(begin, starts).tolist() + [len(begin)]
    of = np.searchsorted(starts, begin, side="right") - 1
    ranges = list(zip((begin - starts[of]).tolist(), (finish - starts[of]).tolist(), strict=True))
    return [ranges[a:b] for a, b in zip(cuts, cuts[1:])]


def _sorted_pieces(length: int, sort_bytes: int):
    """Partitions in the order of keys -> ranges of repeated window starts of every piece."""

    def emit(group):
        bodies = [b for _, _, b, _ in group] + [b for _, _, b, times in group if times > 1]
        found = repeated_windows(bodies, length)
        got = [(key, name, ranges) for (key, name, _, _), ranges in zip(group, found, strict=False) if ranges]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([[{"begin": a, "finish": b} for a, b in g[2]] for g in got], _RANGES)],
            names=["key", "name", "ranges"],
        )

    def run(batches):
        group, size, last = [], 0, None
        for batch in batches:
            for key, name, body, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= sort_bytes:
                    yield emit(group)
                    group, size = [], 0
                group.append((key, name, body, times))
                size += len(body) * min(2, times)
                last = key
        if group:
            yield emit(group)

    return run


def _sort(distinct: DataFrame, length: int, sort_bytes: int) -> DataFrame:
    """(key, name, ranges) of distinct (key, name, body, times)."""
    dealt = distinct.select("key", "name", "body", "times").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_sorted_pieces(length, sort_bytes), f"key bigint, name binary, ranges {RANGES}")


def _large(distinct: DataFrame, sort_bytes: int) -> DataFrame:
    size = F.sum(F.col("size") * F.least("times", F.lit(2)))
    return distinct.groupBy("key").agg(size.alias("bytes")).where(F.col("bytes") > sort_bytes).select("key")


def _repeated(pieces: RowStore, length: int, gram: int, sort_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(anchor, piece, ranges) from stored pieces; several rows for a piece that was split."""
    # Names first, without the bytes: one occurrence of each name stands for all.
    named = pieces.table.groupBy("anchor", "piece").agg(F.sum("times").alias("times"), F.first("size").alias("size"), F.min(F.struct("row", "begin")).alias("one"))
    chosen = named.select(F.col("anchor").alias("key"), F.col("piece").alias("name"), "times", "size", "one.row", F.col("one.begin").alias("first"))
    bodies = pieces.join(chosen, "begin", "body").where("begin = first").select("key", "name", "times", "size", "body")
    first = materialize(bodies, "bodies")
    tables, large = [first], materialize(_large(first, sort_bytes), "large")
    if large.isEmpty():
        drop_table(large)
        found = materialize(_sort(first, length, sort_bytes), "ranges")
        drop_table(first)
        return found.withColumnsRenamed({"key": "anchor", "name": "piece"}), [found]
    small = materialize(_sort(first.join(large, "key", "left_anti"), length, sort_bytes), "ranges")
    out, tables = small.withColumnsRenamed({"key": "anchor", "name": "piece"}), [small]
    # Cores begin as the anchor's gram, whose place each piece looks up.
    hot = first.join(large, "key").select(F.col("key").alias("anchor"), F.col("name").alias("piece"), F.lit(0).cast("bigint").alias("offset"), "times", F.lit(0).alias("core_at"), F.lit(-gram).alias("core_size"), "body")
    before = [first, large]
    while True:
        parts = materialize(hot.mapInArrow(_split(length), _SPLIT), "parts")
        for t in before:
            drop_table(t)
        distinct = materialize(parts.groupBy("key", "name").agg(F.sum("times").alias("times"), F.first("body").alias("body")).withColumn("size", F.length("body")), "distinct")
        large = materialize(_large(distinct, sort_bytes), "large")
        found = _sort(distinct.join(large, "key", "left_anti"), length, sort_bytes)
        back = parts.select("anchor", "piece", "offset", "key", "name").join(found, ["key", "name"])
        shifted = F.transform("ranges", lambda r: F.struct((r["begin"] + F.col("offset")).cast("int").alias("begin"), (r["finish"] + F.col("offset")).cast("int").alias("finish")))
        solved = materialize(back.select("anchor", "piece", shifted.alias("ranges")), "ranges")
        tables.append(solved)
        out = out.unionByName(solved)
        drop_table(distinct)
        if large.isEmpty():
            drop_table(parts)
            drop_table(large)
            return out, tables
        hot = parts.join(large, "key").drop("key", "name")
        before = [parts, large]


# ---------------------------------------------------------------- removal
def _cut(length: int):
    """Texts with the window ranges found in them -> what is left of each."""

    def run(batches):
        for block in text_blocks(batches):
            found = block.column("found").to_pylist()
            removed, spans, kept = [], [], []
            for raw, ranges in zip(block.docs(), found, strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((r["begin"], r["finish"] - 1 + length) for r in ranges):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, rest = 0, hashlib.sha256()
                for a, b in runs:
                    rest.update(raw[at:a])
                    at = b
                rest.update(raw[at:])
                kept.append(rest.hexdigest())
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"begin": a, "finish": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([block.column("text_key"), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], names=["text_key", "n_removed", "spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges).

    The work is done by the call; its tables are dropped and the session's settings are as before when it returns.
    """
    with restored(docs.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        return _remove_repeats(docs, id_col, text_col, length, gram, sort_bytes)


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, sort_bytes: int) -> DataFrame:
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    source = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    scanned = source.mapInArrow(_scan(length, gram), f"doc_id {kind}, text_key binary, text string, anchors array<bigint>, looped array<bigint>")
    store = RowStore(scanned.withColumn("n_bytes", F.octet_length("text").cast("bigint")), "texts")
    # The first row of each text takes part for all of them.
    texts = materialize(store.select("text_key").groupBy("text_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")).select("row", F.least("copies", F.lit(2)).alias("times")), "texts")
    uses = store.join(texts, "anchors").select("row", "times", F.posexplode("anchors").alias("nth", "anchor"))
    # A table of its own, so that Spark can split the tasks of an anchor that is everywhere.
    again = store.join(texts, "looped").select("times", F.explode("looped").alias("anchor"))
    counted = uses.select("times", "anchor").unionByName(again)
    shared = materialize(counted.groupBy("anchor").agg(F.sum("times").alias("uses")).where("uses > 1").select("anchor"), "shared")
    asked = uses.join(shared, "anchor").groupBy("row").agg(F.first("times").alias("times"), F.collect_list("nth").alias("shared"))
    asked = materialize(asked, "asked")
    cut = store.join(asked, "text").select("row", "times", "shared", "text").mapInArrow(_pieces(length, gram), "row bigint, begin bigint, times bigint, anchor bigint, piece binary, body binary")
    pieces = RowStore(cut.withColumn("size", F.length("body")), "pieces", "row", store.buckets)
    for t in (shared, asked):
        drop_table(t)
    ranges, tables = _repeated(pieces, length, gram, max(sort_bytes, 2 * length))
    found = (
        pieces.select("begin", "anchor", "piece")
        .join(ranges, ["anchor", "piece"])
        .select("row", "begin", F.explode("ranges").alias("r"))
        .groupBy("row")
        .agg(F.collect_list(F.struct((F.col("begin") + F.col("r.begin")).alias("begin"), (F.col("begin") + F.col("r.finish")).alias("finish"))).alias("found"))
    )
    found = materialize(found, "found")
    for t in (pieces.table, *tables):
        drop_table(t)
    edited = materialize(store.join(found, "text_key", "text").select("text_key", "text", "found").mapInArrow(_cut(length), f"text_key binary, n_removed bigint, spans {SPANS}, kept_sha256 string"), "edited")
    base = store.select("doc_id", "text_key", "n_bytes").drop("part", "row")
    # Digests and spans only; Spark removes the checkpoint with the last plan that reads it.
    out = checkpointed(base.join(edited, "text_key", "left"))
    for t in (found, texts, store.table, edited):
        drop_table(t)
    spans = F.coalesce("spans", F.array().cast(SPANS))
    kept = F.coalesce("kept_sha256", F.lower(F.hex("text_key")))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.size(spans).cast("bigint").alias("n_spans"), kept.alias("kept_sha256"), spans.alias("spans"))
