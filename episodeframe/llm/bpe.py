"""Operator 9: byte-level BPE by a hierarchical-bitmap rank queue.

One pre-token is a doubly linked list of its bytes.  Every adjacent pair that
the vocabulary can merge waits in the bucket of its rank; a two-level bitmap
over the ranks (256 ranks a leaf) tells the smallest rank that has a waiting
pair by find-first-set, so taking the next merge costs a constant number of
steps however long the pre-token is.  Merging makes the neighbours'
pairs stale; they are left in their buckets and skipped when they come up.
Within a rank the leftmost pair goes first.

Pre-tokens repeat, so their ids are kept in two tables of bounded size: when
the young one is full it becomes the old one, and what is used again moves up.

Defined results: null text counts as empty and has no ids; rows come back one
for one, repeated ones too, in no particular order; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from episodeframe.llm.blocks import give_back, text_blocks
from episodeframe.llm.shared import narrow

RANK_FILE = "byte_bpe_50k.tiktoken"
CACHE_PIECES, KEPT_PIECES, CACHE_BYTES = 300_000, 300_000, 64
_FANOUT, _LOW = 8, 255


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Waiting pairs by rank: a bit for each rank in ``leaf``, one for each leaf in ``top``.

    ``leaf`` and ``buckets`` are empty again after every pre-token, so one
    queue serves them all.
    """

    __slots__ = ("buckets", "leaf")

    def __init__(self, ranks: int) -> None:
        self.leaf = [0] * ((ranks >> _FANOUT) + 1)
        self.buckets: dict[int, list[int]] = {}


def merge_piece(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> tuple[int, ...]:
    """Ids of one pre-token."""
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    leaf, buckets = queue.leaf, queue.buckets
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
    waiting.append(None)
    top = 0
    for at, rank in enumerate(waiting):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(at)
            else:
                buckets[rank] = [at]
                leaf[rank >> _FANOUT] |= 1 << (rank & _LOW)
                top |= 1 << (rank >> _FANOUT)
    while top:
        # Find-first-set in both levels gives the smallest waiting rank.
        first = top & -top
        group = first.bit_length() - 1
        bits = leaf[group]
        bit = bits & -bits
        rank = (group << _FANOUT) | (bit.bit_length() - 1)
        bucket = buckets[rank]
        if len(bucket) > 1:
            at = heappop(bucket)
        else:
            at = bucket[0]
            del buckets[rank]
            leaf[group] = bits ^ bit
            if bits == bit:
                top ^= first
        if waiting[at] != rank:
            continue
        gone = after[at]
        end = after[gone]
        waiting[gone] = None
        after[at] = end
        left = before[at]
        if end < n:
            before[end] = at
            fresh = rank_of(piece[at : after[end]])
        else:
            fresh = None
        waiting[at] = fresh
        if fresh is not None:
            if fresh in buckets:
                heappush(buckets[fresh], at)
            else:
                buckets[fresh] = [at]
                leaf[fresh >> _FANOUT] |= 1 << (fresh & _LOW)
                top |= 1 << (fresh >> _FANOUT)
        if left >= 0:
            fresh = waiting[left] = rank_of(piece[left:end])
            if fresh is not None:
                if fresh in buckets:
                    heappush(buckets[fresh], left)
                else:
                    buckets[fresh] = [left]
                    leaf[fresh >> _FANOUT] |= 1 << (fresh & _LOW)
                    top |= 1 << (fresh >> _FANOUT)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return tuple(ids)


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.queue = RankQueue(max(self.tokens, default=0))
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _learn(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8")
            ids = merge_piece(raw, self.ranks, self.queue)
            if len(raw) > CACHE_BYTES:
                return ids
        if len(self.young) >= CACHE_PIECES:
            self.old, self.young = self.young, {}
        self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, learn = self.young.get, self._learn
        return list(chain.from_iterable([get(p) or learn(p) for p in self.find(text)]))

    def trim(self) -> None:
        """After a task: the worker may go on to other work, so only the first entries, mostly frequent ones, stay."""
        self.old = {}
        self.young = dict(islice(self.young.items(), KEPT_PIECES))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def spell(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker: the rank file stays loaded between tasks."""
    return Codec(load_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids array<int>."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    source = narrow(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = codec(path, pattern)
        gc.disable()  # the tables hold no cycles; walking them again and again costs more than the encoding
        try:
            yield from encoded(coder, batches)
        finally:
            gc.enable()
            coder.trim()
            give_back()

    def encoded(coder, batches):
        for block in text_blocks(batches):
            counts, spelled, decoded, lists = [], [], [], []
            for raw in block.docs():
                ids = coder.encode(raw.decode("utf-8"))
                counts.append(len(ids))
                spelled.append(hashlib.sha256(coder.spell(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
