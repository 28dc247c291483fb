"""Operator 2: benchmark decontamination with an FM-index per training shard.

A *shard* is a run of documents of one task, about ``SHARD_BYTES`` of text.
Its words are looked up in the benchmark's vocabulary; only runs of known words
at least as long as the shortest window can hold a match, and these are indexed
(an unknown word ends a run, so nothing is lost).  All windows of the benchmark
are then searched backwards at once, their occurrences located, and the hit
words of a document merged into removal spans.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` of
text; larger ones take several passes over the same text whose spans are
merged.  ``clean`` hands the spans on from pass to pass as word positions and
cuts once, in the last: what it cuts doesn't depend on the number of blocks.

Defined results: null text has no words; an item with fewer than ``WINDOW``
words is one window; items without words never occur; the words of an item
whose id is null are hit like others, but it has no name, so ``n_items`` and
the list of items leave it out; windows of several items
count for each; repeated rows each get a row; an empty benchmark hits nothing.
Other columns are ignored (or kept as they are, in ``clean``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from episodeframe.llm.blocks import ALNUM, text_blocks, words_of
from episodeframe.llm.fm_index import FMIndex
from episodeframe.llm.shared import bounded_batches, narrow

WINDOW = 10
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())]))


class Phrases:
    """The distinct windows of a block of items, as ids of their words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocabulary = np.zeros(0, dtype=np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        batch = pa.record_batch({"text": pa.array([t for _, t in items], pa.string())})
        hashed: list[np.ndarray] = []
        for block in text_blocks([batch]):
            words = words_of(block, ALNUM)
            h = words.hashes()
            hashed += [h[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        if not any(len(h) for h in hashed):
            return
        self.vocabulary = np.unique(np.concatenate(hashed))
        owners: dict[int, dict[tuple, set[str]]] = {}
        for (name, _), h in zip(items, hashed, strict=True):
            ids = (np.searchsorted(self.vocabulary, h) + 1).tolist()
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).update([] if name is None else [name])
        self.by_length = {size: (np.array(list(w), dtype=np.int64), [sorted(x) for x in w.values()]) for size, w in owners.items()}

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=1 << 60)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Ids from 1, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Shard:
    """Documents whose runs of known words are indexed together."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.blocks, self.size = phrases, [], 0
        self.runs: list[np.ndarray] = []
        self.places: list[tuple[int, int]] = []  # (document of the shard, first word)
        self.docs = 0

    def add(self, block) -> None:
        words = words_of(block, ALNUM)
        ids = self.phrases.known(words.hashes())
        doc = np.repeat(np.arange(len(block)), np.diff(words.first))
        # Runs of known words of one document.
        known = ids > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1] | (np.diff(doc) != 0)
        finish = known.copy()
        finish[:-1] &= ~known[1:] | (np.diff(doc) != 0)
        for a, b in zip(np.flatnonzero(begin).tolist(), (np.flatnonzero(finish) + 1).tolist(), strict=True):
            if b - a >= self.phrases.shortest:
                d = int(doc[a])
                self.runs.append(ids[a:b])
                self.places.append((self.docs + d, a - int(words.first[d])))
        self.blocks.append((block, words))
        self.docs += len(block)
        self.size += len(block.data)

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each document the merged [first, last) word spans, and the items."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.docs)]
        items: list[set[str]] = [set() for _ in range(self.docs)]
        if not self.runs:
            return spans, items
        text = np.concatenate([np.append(r, 0) for r in self.runs])
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in self.runs])])
        index = FMIndex(text, len(self.phrases.vocabulary) + 1)
        found: list[tuple[int, int, int]] = []
        for size, (windows, owners) in self.phrases.by_length.items():
            low, high = index.search(windows)
            hit = np.flatnonzero(high > low)
            count = high[hit] - low[hit]
            rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at = index.locate(rows)
            run = np.searchsorted(begins, at, side="right") - 1
            for r, offset, which in zip(run.tolist(), (at - begins[run]).tolist(), np.repeat(hit, count).tolist(), strict=True):
                doc, first = self.places[r]
                found.append((doc, first + offset, first + offset + size))
                items[doc].update(owners[which])
        for doc, a, b in sorted(found):
            if spans[doc] and a <= spans[doc][-1][1]:
                spans[doc][-1] = (spans[doc][-1][0], max(spans[doc][-1][1], b))
            else:
                spans[doc].append((a, b))
        return spans, items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(phrases: Phrases, columns: list[str], text_col: str, shard_bytes: int, cut: bool = False, earlier: str | None = None, later: str | None = None):
    """Rows with their hits; or, with ``cut``, the rows as they were with the hit spans taken out of the text.

    Column ``earlier`` has word spans of passes before, which are joined to those
    found; with ``later`` the rows stay as they were, with all word spans so far
    in a column of that name.
    """

    def emit(shard: Shard):
        spans, items = shard.hits()
        if earlier:
            before = [x for block, _ in shard.blocks for x in block.column(earlier).to_pylist()]
            spans = [_joined([*x, *((s["begin"], s["finish"]) for s in e)]) if e else x for x, e in zip(spans, before, strict=True)]
        at = 0
        for block, words in shard.blocks:
            first = words.first.tolist()
            mine, names = spans[at : at + len(block)], items[at : at + len(block)]
            at += len(block)
            if later:
                word_spans = [[{"begin": a, "finish": b} for a, b in x] for x in mine]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in columns), pa.array(word_spans, _SPANS)], names=[*columns, later])
                continue
            n_words = np.diff(words.first)
            places = [
                [{"begin": int(words.starts[f + a] - s), "finish": int(words.ends[f + b - 1] - s)} for a, b in x] if x else []
                for x, f, s in zip(mine, first, block.starts.tolist(), strict=False)
            ]
            if cut:
                texts = pa.array([_without(raw, x) for raw, x in zip(block.docs(), places, strict=True)], pa.string())
                kept = block.column(text_col)
                texts = pc.if_else(pc.is_null(kept), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([texts.cast(kept.type) if c == text_col else block.column(c) for c in columns], names=columns)
                continue
            word_spans = [[{"begin": a, "finish": b} for a, b in x] for x in mine]
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(word_spans, _SPANS), pa.array(places, _SPANS), pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                names=[*columns, "n_words", "hit_words", "hit_bytes", "items"],
            )

    def run(batches):
        shard = Shard(phrases)
        for block in text_blocks(batches, text_col):
            shard.add(block)
            if shard.size >= shard_bytes:
                yield from emit(shard)
                shard = Shard(phrases)
        yield from emit(shard)

    return run


def _hits(docs: DataFrame, items: list[tuple[str, str | None]], text_col: str, columns: list[str], shard_bytes: int) -> DataFrame:
    span = "array<struct<begin:bigint,finish:bigint>>"
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return bounded_batches(docs).mapInArrow(_scan(Phrases(items), columns, text_col, shard_bytes), f"{kinds}, n_words bigint, hit_words {span}, hit_bytes {span}, items array<string>")


def _merge(spans):
    """JVM: the union of span lists, merged."""
    ordered = F.array_sort(F.flatten(spans))
    none = F.array().cast("array<struct<begin:bigint,finish:bigint>>")

    def step(done, s):
        last = F.element_at(done, -1)
        joined = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["finish"] >= s["begin"])
        return F.when(joined, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["finish"], s["finish"]).alias("finish"))))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, none, step)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """Lists of (item id as string or None, text), each of about ``limit`` bytes at most."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = int(total // limit) + 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words, hit_bytes, items."""
    source = narrow(docs, doc_id=id_col, text=text_col)
    blocks = list(item_blocks(benchmark, item_col, item_text_col, block_bytes)) or [[]]
    if len(blocks) == 1:
        found = _hits(source, blocks[0], "text", ["doc_id"], shard_bytes)
    else:
        # The same rows in every pass: told apart by id and text, repeats counted.
        keyed = source.withColumn("text_key", F.xxhash64("text"))
        parts = [_hits(keyed, items, "text", ["doc_id", "text_key"], shard_bytes).withColumn("pass", F.lit(k)) for k, items in enumerate(blocks)]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        found = (
            union.groupBy("doc_id", "text_key")
            .agg(
                F.max("n_words").alias("n_words"),
                _merge(F.collect_list("hit_words")).alias("hit_words"),
                _merge(F.collect_list("hit_bytes")).alias("hit_bytes"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                F.sum((F.col("pass") == 0).cast("int")).alias("times"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        )
    n_hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda a, s: a + s["finish"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hit_words", "hit_bytes", "items"
    )


def _without(raw: bytes, spans) -> str:
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["begin"]])
        at = s["finish"]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", errors="strict")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with every hit span cut out of the text (and the length column set anew); all rows and columns stay."""
    kind = docs.schema
    held, earlier = "__hit_words", None
    while held in kind.names:
        held += "_"
    span = StructType([StructField("begin", LongType()), StructField("finish", LongType())])
    with_hits = StructType([*kind.fields, StructField(held, ArrayType(span))])
    blocks = item_blocks(benchmark, "item_id", "text", block_bytes)
    items = next(blocks)
    for following in blocks:
        docs = bounded_batches(docs).mapInArrow(_scan(Phrases(items), kind.names, text_col, shard_bytes, earlier=earlier, later=held), with_hits)
        items, earlier = following, held
    docs = bounded_batches(docs).mapInArrow(_scan(Phrases(items), kind.names, text_col, shard_bytes, cut=True, earlier=earlier), kind)
    if length_col in kind.names:
        docs = docs.withColumn(length_col, F.length(text_col).cast(kind[length_col].dataType))
    return docs
