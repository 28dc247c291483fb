"""Content-defined chunking with a gear rolling hash, vectorised over blocks.

``h = (h << 1) + G[byte]`` in 32 bits depends on the last 32 bytes only, so a
cut depends on nothing but the bytes before it: inserting text moves no cut
further than one chunk away.  The recurrence is evaluated for all positions
at once by doubling: the sum over 2w bytes is two sums over w bytes.
"""

from __future__ import annotations

import numpy as np

from episodeframe.llm.blocks import Block, mix64

WINDOW = 32
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    h = GEAR[data]
    w = 1
    while w < WINDOW:
        if len(h) > w:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    return h


def chunk_bounds(block: Block, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): chunks of every document of the block.

    A cut stands where the top ``bits`` hash bits are zero and no other such
    place lies in the ``least`` bytes before it; both rules look at nearby
    bytes only.  No chunk crosses documents; an empty document has none.
    """
    n = len(block.data)
    hits = np.flatnonzero((gear_hashes(block.data) >> np.uint32(32 - bits)) == 0) + 1
    if len(hits):
        doc = np.searchsorted(block.starts, hits - 1, side="right") - 1
        inside = (hits - block.starts[doc] >= WINDOW) & (hits < block.ends[doc])
        hits, doc = hits[inside], doc[inside]
    if len(hits):
        alone = np.ones(len(hits), dtype=bool)
        alone[1:] = (np.diff(hits) >= least) | (np.diff(doc) != 0)
        hits = hits[alone]
    full = block.starts < block.ends
    starts = np.union1d(block.starts[full], hits)
    ends = np.append(starts[1:], n)
    first = np.append(np.searchsorted(starts, block.starts, side="left"), len(starts))
    return starts, ends, first
