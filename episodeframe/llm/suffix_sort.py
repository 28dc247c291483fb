"""Two-stage suffix sorting of byte strings, to a limited depth.

A suffix is *small* if it is less than the one that starts a byte later.  Only
small suffixes are sorted by comparison; every other suffix follows from the
order of its successor in one scan over the buckets of first bytes, smallest
first, all entries of a bucket at a time.
"""

from __future__ import annotations

import numpy as np

#: suffixes sorted by comparison at once; bytes compared at once
TOGETHER, COMPARED = 1 << 12, 1 << 22


def small_suffixes(text: np.ndarray) -> np.ndarray:
    """Boolean: suffix i < suffix i+1 (the last one is greater than the end)."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    # Equal bytes take the direction of the next change.
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def words_at(text: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from every place on as a little-endian number, zeros behind the end."""
    padded = np.zeros(len(text) + beyond + 8, dtype=np.uint8)
    padded[: len(text)] = text
    return np.ascontiguousarray(np.ndarray(shape=(len(text) + beyond,), dtype="<u8", buffer=padded.data, strides=(1,)))


def in_order(text: np.ndarray, raw: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes' first ``depth`` bytes, by comparison.

    First by eight bytes at once.  What agrees there is compared whole, some
    ``TOGETHER`` suffixes at a time, so that the compared strings stay in the cache.
    """
    first = words_at(text, 8)[starts].byteswap()
    order = np.argsort(first, kind="stable")
    starts, first = starts[order], first[order]
    borders = np.append(np.flatnonzero(first[1:] != first[:-1]) + 1, len(starts))
    out: list[int] = []
    low = 0
    while low < len(starts):
        high = int(borders[min(np.searchsorted(borders, low + TOGETHER), len(borders) - 1)])
        out.extend(sorted(starts[low:high].tolist(), key=lambda i: raw[i : i + depth]))
        low = high
    return np.array(out, dtype=np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of the suffixes' first ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    small = small_suffixes(text)
    raw = text.tobytes()
    direct = np.flatnonzero(small)
    direct = in_order(text, raw, direct, depth)
    heads = text[direct] if len(direct) else np.zeros(0, np.uint8)

    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[int(text[-1])].append(np.array([n - 1], dtype=np.int64))
    out: list[np.ndarray] = []

    def induce(batch: np.ndarray, bucket: int) -> np.ndarray:
        """Place the greater predecessors; returns those of this very bucket."""
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        own = before[byte == bucket]
        rest = byte != bucket
        before, byte = before[rest], byte[rest]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for part, b in zip(np.split(before, cuts), byte[np.append(0, cuts)].tolist(), strict=True):
                large[b].append(part)
        return own

    for bucket in range(256):
        pending = large[bucket]
        while pending:
            following = []
            for batch in pending:
                out.append(batch)
            own = induce(np.concatenate(pending), bucket)
            if len(own):
                following.append(own)
            pending = following
        lo, hi = np.searchsorted(heads, [bucket, bucket + 1]) if len(heads) else (0, 0)
        if hi > lo:
            out.append(direct[lo:hi])
            induce(direct[lo:hi], bucket)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in ``order``: length of the common prefix, at most ``depth``; the first has 0.

    Compared eight bytes at a time, and only pairs that agree so far go on.
    """
    n = len(text)
    words = words_at(text, depth)
    out = np.zeros(len(order), dtype=np.int64)
    live, one, other = np.arange(1, len(order)), order[1:], order[:-1]
    for at in range(0, depth, 8):
        if not len(live):
            break
        bits = words[at:].take(one) ^ words[at:].take(other)
        differ = np.flatnonzero(bits)
        if len(differ):
            # The lowest differing byte of a little-endian word comes first in the text.
            low = bits[differ] & (~bits[differ] + np.uint64(1))
            out[live[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            same = np.flatnonzero(bits == 0)
            live, one, other = live[same], one[same], other[same]
    out[live] = depth
    # A prefix can't reach beyond the end of the text.
    if len(order) > 1:
        out[1:] = np.minimum(out[1:], n - np.maximum(order[1:], order[:-1]))
    return np.minimum(out, depth)


def common_to(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in ``order``: whether their common prefix has ``depth`` bytes; the first has none.

    Both ends are compared first, eight bytes each.  What agrees there is compared
    whole, by runs of suffixes whose neighbours are the same distance away: a byte
    of such a run is compared once for all the prefixes that it belongs to.
    """
    out = np.zeros(len(order), dtype=bool)
    words = words_at(text, depth)
    one, other = order[1:], order[:-1]
    alike = np.maximum(one, other) + depth <= len(text)
    for at in (0, max(0, depth - 8)) if depth >= 8 else ():
        alike &= words[at:].take(one) == words[at:].take(other)
    places = np.flatnonzero(alike)
    if not len(places):
        return out
    places = places[np.argsort(one[places])]
    start, away = one[places], other[places] - one[places]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(away) != 0)]))
    sizes = np.diff(np.append(first, len(places)))
    spans = sizes + depth - 1
    ends = np.cumsum(spans)
    low = 0
    while low < len(first):
        # At least one run, and no more bytes than ``COMPARED`` with several.
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED, side="right")))
        span, size = spans[low:high], sizes[low:high]
        begin = np.cumsum(span) - span
        at = np.arange(int(span.sum())) + np.repeat(start[first[low:high]] - begin, span)
        differ = np.append(0, np.cumsum(text[at] != text[at + np.repeat(away[first[low:high]], span)], dtype=np.int64))
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        upto = first[high] if high < len(first) else len(places)
        out[places[first[low] : upto] + 1] = differ[nth + depth] == differ[nth]
        low = high
    return out
