"""FM-index over a sequence of small integers, all operations vectorised.

The Burrows-Wheeler transform is kept as a wavelet tree in matrix form: one
bit per level and symbol, with running counts for rank.  Every ``SAMPLE``-th
text position is stored; others are found by walking back to one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the end sorts before everything."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if width < n:
            second[:-width] = rank[width:]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n:
            return order
        width *= 2


class FMIndex:
    """Index of ``text`` (integers from 0; 0 is never part of a pattern)."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text)
        self.n = n = len(text)
        # Row 0 is the empty suffix.
        rows = np.concatenate([[n], order])
        self.bwt = np.where(rows > 0, text[rows - 1], 0).astype(np.int64)
        self.start_row = int(np.flatnonzero(rows == 0)[0])
        counts = np.bincount(text, minlength=symbols)
        self.before = 1 + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.sampled = rows % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = rows[self.sampled]
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        level = self.bwt
        for shift in range(self.levels - 1, -1, -1):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n + 1 - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        # Where each symbol's run begins below the last level.
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, shift in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> shift) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first ``at`` places of the transform."""
        found = self._descend(symbol, at) - self.base[symbol]
        # The row of the whole text holds no symbol, though it is stored as 0.
        return found - ((symbol == 0) & (at > self.start_row))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of equally long patterns, by backward search."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n + 1, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            a = self.before[symbol] + self.rank(symbol, low[live])
            b = self.before[symbol] + self.rank(symbol, high[live])
            low[live], high[live] = a, b
            gone = live[a >= b]
            high[gone] = low[gone]
            live = live[a < b]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the nearest sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        live, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            hit = self.sampled[row]
            out[live[hit]] = self.samples[self.sample_rank[row[hit]]] + steps
            live, row = live[~hit], row[~hit]
            symbol = self.bwt[row]
            row = self.before[symbol] + self.rank(symbol, row)
            steps += 1
        return out
