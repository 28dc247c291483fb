"""Byte-level views of Arrow text columns, shared by the operators.

A *block* is a run of whole documents whose UTF-8 bytes lie in one contiguous
numpy array; a document is never cut.  Blocks keep the working set of the
vectorised passes small however many rows an Arrow batch holds.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: spans are hashed a stretch of so many bytes at a time, which bounds the tables of powers
STRETCH = 1 << 19


@dataclass
class Block:
    """Rows ``first..last`` of a batch; ``starts``/``ends`` index ``data``."""

    batch: pa.RecordBatch
    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.first, self.last - self.first)

    def docs(self) -> Iterator[bytes]:
        raw = self.data.tobytes()
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            yield raw[s:e]

    def __len__(self) -> int:
        return self.last - self.first


def text_blocks(batches, text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes (one long document may exceed it); null text is empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        col = pc.fill_null(col.cast(pa.large_string()), "")
        _, offs, data = col.buffers()
        offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
            j = min(n, max(j, i + 1))
            base = offsets[i]
            yield Block(batch, i, j, raw[base : offsets[j]], offsets[i:j] - base, offsets[i + 1 : j + 1] - base)
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: reused workers would hold it while others work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ------------------------------------------------------------------ words
def byte_class(separators) -> np.ndarray:
    """Table byte -> is a word byte, given the separator bytes."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: words [^\x20\x09-\x0D]+
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _pow_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * STRETCH:
            _powers[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the weighted sum of data[i:j] modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow_table(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    inverse = _pow_table(_BASE_INV, len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hash`` of spans whose starts and ends ascend, whatever the length of ``data``."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + STRETCH, side="right")))
        prefix = prefix_hash(data[base : int(ends[j - 1])])
        out[i:j] = span_hash(prefix, starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


@dataclass
class Words:
    """Word byte ranges of a block; ``first[d]..first[d+1]`` are document d's."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def words_of(block: Block, table: np.ndarray) -> Words:
    """Lower-case A-Z and cut the block into words; none crosses documents."""
    data = LOWER[block.data]
    mask = table[data]
    n = len(data)
    inner = block.starts[(block.starts > 0) & (block.starts < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = mask[:-1]
    before[inner] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = mask[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    first = np.append(np.searchsorted(starts, block.starts, side="left"), len(starts))
    return Words(data, starts, ends, first)


def list_column(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
