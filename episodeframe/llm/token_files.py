"""Operator 3: token ids in binary files.

Ids are written as their frequency rank in a byte-aligned variable-length
code: four ids share one *control byte* with two bits each for the number of
data bytes (1 to 4); control bytes and data bytes are kept apart.  Common
tokens take one data byte.  A table of 256 control bytes gives the lengths and
offsets of four ids at once, so decoding is table lookup and gathering in
numpy.

The files are Parquet with one row per *shard block* (Spark's commit protocol
makes them safe against lost or repeated tasks): first the documents of the
block in ascending order of doc_id with their numbers of ids, then the control
bytes and the data bytes.  The rank table is a file of its own beside them.

Steps: encode every text (``staged``), count tokens over the whole corpus,
range-partition the ids by doc_id and write, read back and decode.

Defined results: null text counts as empty and has the end id only; equal
doc_ids stand in the order of their ids' bytes; a null doc_id comes first; no
rows give files without blocks; other columns are ignored.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from episodeframe.llm.blocks import give_back, text_blocks
from episodeframe.llm.shared import drop_table, materialize, narrow, shared_dir

TOKENIZER_FILE, END_ID = "word_bpe_49k.json", 2
BLOCK_IDS = 1 << 18
TEXT_BYTES = 8 << 20
CACHE_WORDS, KEPT_WORDS, JOINED = 400_000, 300_000, 500
#: ASCII punctuation but the apostrophe, which begins pre-tokens of its own
PUNCTUATION = r'!"#$%&()*+,-./:;<=>?@[\]^_`{|}~'
SMALLEST_RANGE_BYTES = 32 << 20


# ------------------------------------------------------------------- codec
_SHIFTS = np.array([0, 2, 4, 6])
#: control byte -> lengths of its four ids, and where each begins
LENGTHS = ((np.arange(256)[:, None] >> _SHIFTS) & 3) + 1
TOTALS = LENGTHS.sum(axis=1)
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes); the last group is filled up with zeros."""
    values = np.zeros(-(-len(ranks) // 4) * 4, dtype="<u4")
    values[: len(ranks)] = ranks
    used = np.ones((len(values), 4), dtype=bool)
    extra = np.zeros(len(values), dtype=np.uint8)
    for k in range(1, 4):
        used[:, k] = values >= 1 << 8 * k
        extra += used[:, k]
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    keys = np.frombuffer(control, dtype=np.uint8)
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, np.uint8)])
    total = TOTALS[keys]
    begins = ((np.cumsum(total) - total)[:, None] + OFFSETS[keys]).reshape(-1)[:count]
    lengths = LENGTHS[keys].reshape(-1)[:count]
    out = np.zeros(count, dtype=np.uint32)
    out[:] = raw[begins]
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --------------------------------------------------------------- tokenizer
class WordEncoder:
    """The library's ids of texts, by a table of words.

    The tokenizer drops white space before its merges and ends every pre-token
    with a word-end token, so a text's ids are its words' ids one after another,
    and many words can be encoded in one call and told apart by their ends.
    Texts that hold one of the library's special tokens go to it whole.
    A word of letters with ASCII punctuation before or behind is looked up in
    these parts; a word of any other form is encoded by itself.  ``exact`` says
    whether this holds for the loaded tokenizer; if not, whole texts go to the
    library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: tokens that the library finds in a text before it cuts words
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.library.get_vocab_size()
        self.wide = size > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        probe = "Ab  c,d\te's 12\néß 'll x' 're (Quoted!) É. Überall; y á ́b  z"
        self.exact = True
        self.exact = not any(c.isspace() for t in self.special for c in t) and self._whole(probe) == self.texts(pa.array([probe]), 0)[0][:-1].tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _encode_parts(self, parts: list[str]) -> None:
        """Each part is one pre-token; one call for ``JOINED`` of them."""
        table, width = self.young, self.kind.itemsize
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        for group, found in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):  # not one word end a part after all
                table.update((p, self._whole(p)) for p in group)
                continue
            raw, at = ids.tobytes(), 0
            for part, cut in zip(group, (cuts * width).tolist(), strict=True):
                table[part] = raw[at:cut]
                at = cut

    def _learn(self, words: list[str]) -> None:
        """Enter new words into the table: letters as they are, others by their parts."""
        table = self.young
        parts = [w for w in words if w.isalpha() and "İ" not in w]
        split, other, extra = [], [], set()
        if len(parts) < len(words):
            for w in words:
                if w.isalpha() and "İ" not in w:
                    continue
                core = w.strip(PUNCTUATION)
                if core.isalpha() and "İ" not in core:
                    at = w.index(core)
                    left, right = w[:at], w[at + len(core) :]
                    split.append((w, left, core, right))
                    extra.add(core)
                    extra.add(left)
                    extra.add(right)
                else:
                    other.append(w)
            extra.discard("")
            extra.difference_update(parts)
            parts += [w for w in extra if w not in table]
        self._encode_parts(parts)
        for w, found in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False), strict=True):
            table[w] = np.array(found.ids, dtype=self.kind).tobytes()
        for w, left, core, right in split:
            ids = table[core] + table[right] if right else table[core]
            table[w] = table[left] + ids if left else ids

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of different words; new ones are learned."""
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        table, old = self.young, self.old
        found = list(map(table.get, words))
        missing = [w for w, f in zip(words, found, strict=True) if f is None]
        if not missing:
            return found
        fresh = []
        for w in missing:
            f = old.get(w)
            if f is None:
                fresh.append(w)
            else:
                table[w] = f
        if fresh:
            self._learn(fresh)
        return list(map(table.__getitem__, words))

    def trim(self) -> None:
        """After a task: the worker may go on to other work, so only the first entries, mostly frequent ones, stay."""
        self.old = {}
        self.young = dict(islice(self.young.items(), KEPT_WORDS))

    def texts(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, edges); every text ends with ``end``.

        The words of the column are told apart by Arrow; what is left to do for
        each place of a word is to gather the word's ids.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        # Arrow cuts at \x1c-\x1f, the tokenizer doesn't; special tokens stand across words.
        whole = pc.match_substring_regex(column, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        for token in self.special:
            whole = whole | pc.match_substring(column, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if not self.exact:
            whole[:] = True
        if not whole.any():
            return self._by_words(column, end)
        ids, edges = self._by_words(column.filter(pa.array(~whole)), end)
        plain = iter(np.split(ids, edges[1:-1]))
        last = np.array([end], self.kind)
        each = [np.append(np.frombuffer(self._whole(t), self.kind), last) if w else next(plain) for t, w in zip(column.to_pylist(), whole.tolist(), strict=True)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def _by_words(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(column):
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        lists = pc.utf8_split_whitespace(column)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        known = self._lookup(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        # The end id is one more word, behind the last of each text; Arrow gathers the words' bytes.
        which = np.insert(words.indices.to_numpy(), offsets[1:], len(known))
        known.append(np.array([end], self.kind).tobytes())
        gathered = pa.array(known, pa.large_binary()).take(pa.array(which))
        stop = np.frombuffer(gathered.buffers()[1], dtype=np.int64)[: len(which) + 1] // self.kind.itemsize
        return np.frombuffer(gathered.buffers()[2], dtype=self.kind, count=int(stop[-1])), stop[offsets + np.arange(len(offsets))]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def staged(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, wide): little-endian ids of 16 bits, or of 32 where the vocabulary needs them (``wide``)."""
    path = path or default_tokenizer()
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        gc.disable()  # the tables hold no cycles
        try:
            yield from encoded(encode, batches)
        finally:
            gc.enable()
            encode.trim()
            give_back()

    def encoded(encode, batches):
        for block in text_blocks(batches, limit=TEXT_BYTES):
            ids, edges = encode.texts(block.column("text"), end_id)
            offsets = pa.py_buffer((edges * encode.kind.itemsize).astype(np.int32).tobytes())
            column = pa.Array.from_buffers(pa.binary(), len(block), [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), column, pa.array([encode.wide] * len(block), pa.bool_())], names=["doc_id", "ids", "wide"])

    return source.mapInArrow(run, f"doc_id {kind}, ids binary, wide boolean")


def _flat(column: pa.Array, wide: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of a binary column one after another, edges of the rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    kind = np.dtype("<u4" if wide[0].as_py() else "<u2")
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=kind), (offsets - offsets[0]) // kind.itemsize


def ranks_by_frequency(ids: DataFrame) -> np.ndarray:
    """Token ids, most frequent first; ties by id.  At most as long as the vocabulary."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.bincount(_flat(batch.column(0), batch.column(1))[0])
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(total[token], pa.int64())], names=["token", "n"])

    counts = ids.select("ids", "wide").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "token"], ascending=[False, True])["token"].to_numpy(dtype=np.int64)


def write_files(ids: DataFrame, by_rank: np.ndarray, folder: str, partitions: int, block_ids: int = BLOCK_IDS) -> None:
    """Ascending doc_id over the partitions and within them."""
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    kind = ids.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(ids.schema["doc_id"].dataType)

    def run(batches):
        def block(part, names, parts, sizes, before):
            ranks = np.concatenate(parts)
            control, data = pack(ranks)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(ranks)], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["shard", "before", "doc_ids", "counts", "n_ids", "control", "data"],
            )

        names, parts, sizes, size, before, part = [], [], [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(3)[0].as_py()
            flat, edges = _flat(batch.column(1), batch.column(2))
            ranks, ids_of = rank_of[flat], batch.column(0).to_pylist()
            at, n = 0, len(ids_of)
            while at < n:
                # As many whole documents as fill the block.
                upto = min(n, max(at + 1, int(np.searchsorted(edges, edges[at] + block_ids - size, side="left"))))
                names += ids_of[at:upto]
                parts.append(ranks[edges[at] : edges[upto]])
                sizes += np.diff(edges[at : upto + 1]).tolist()
                size += int(edges[upto] - edges[at])
                at = upto
                if size >= block_ids:
                    yield block(part, names, parts, sizes, before)
                    names, parts, sizes, size, before = [], [], [], 0, before + size
        if names:
            yield block(part, names, parts, sizes, before)

    ordered = ids.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "ids")
    shards = ordered.select("doc_id", "ids", "wide", F.spark_partition_id().alias("shard"))
    shards.mapInArrow(run, f"shard int, before bigint, doc_ids array<{kind}>, counts array<int>, n_ids bigint, control binary, data binary").write.parquet(f"{folder}/blocks")
    spark = ids.sparkSession
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "tokens binary").coalesce(1).write.parquet(f"{folder}/ranks")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the files."""
    by_rank = np.frombuffer(bytes(spark.read.parquet(f"{folder}/ranks").head()[0]), dtype="<u4")
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = to_arrow_type(blocks.schema["doc_ids"].dataType.elementType)

    # One row for each output partition: what all shards before it hold.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))

    def run(batches):
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "before", "doc_ids", "counts", "n_ids", "control", "data"))
            for shard, before, doc_ids, counts, n, control, data in zip(*columns, strict=True):
                ids = by_rank[unpack(control, data, n)]
                edges = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, id_type), pa.array([shard] * len(doc_ids), pa.int32()), pa.array(before + edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"],
                )

    decoded = blocks.mapInArrow(run, f"doc_id {kind}, shard int, place bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the corpus' ids to ``folder`` (in the shared folder by default) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ids = materialize(staged(docs, path, end_id, id_col, text_col), "ids")
    by_rank = ranks_by_frequency(ids)
    bytes_ = ids.agg(F.sum(F.length("ids"))).head()[0] or 0
    partitions = max(8, int(bytes_ // SMALLEST_RANGE_BYTES) + 1)
    write_files(ids, by_rank, folder, partitions)
    drop_table(ids)
    return read_files(spark, folder)
