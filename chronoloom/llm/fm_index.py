"""An FM-index over a sequence of small integers, all in numpy: suffix array by
prefix doubling, Burrows-Wheeler transform in a wavelet matrix, and positions
sampled at every `every`-th place of the text."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the end of the text is smaller than every symbol."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width, order = 1, np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, dtype=np.int64)
        if width < n:
            after[:-width] = rank[width:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        width *= 2


class FMIndex:
    """Symbols 1 .. top - 1; 0 ends the text (it is added here)."""

    def __init__(self, text: np.ndarray, top: int, every: int = 8):
        self.text_length = len(text)
        full = np.concatenate([np.asarray(text, dtype=np.int64), [0]])
        order = np.concatenate([[len(text)], suffix_array(full[:-1])]).astype(np.int64)
        bwt = full[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(full, minlength=top))]).astype(np.int64)
        self.levels = max(1, int(top - 1).bit_length())
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.ones.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.known = order % every == 0
        self.place = np.zeros(len(order), dtype=np.int64)
        self.place[self.known] = order[self.known]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first `at` places of the transform."""
        lo, hi = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            lo = np.where(bit == 1, self.zeros[k] + a, lo - a)
            hi = np.where(bit == 1, self.zeros[k] + b, hi - b)
        return hi - lo

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        at, symbol, start = row.copy(), np.zeros_like(row), np.zeros_like(row)
        for k in range(self.levels):
            a = self.ones[k][at].astype(np.int64)
            bit = self.ones[k][at + 1] - a
            s = self.ones[k][start].astype(np.int64)
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + a, at - a)
            start = np.where(bit == 1, self.zeros[k] + s, start - s)
        return self.below[symbol] + at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of `patterns` (one length): their row intervals [lo, hi)."""
        n = len(patterns)
        lo, hi = np.zeros(n, dtype=np.int64), np.full(n, self.text_length + 1, dtype=np.int64)
        live = np.arange(n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            lo[live] = self.below[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.below[symbol] + self.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to a sampled one."""
        rows = rows.copy()
        out, steps = np.full(len(rows), -1, dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.known[rows[live]]
            out[live[done]] = self.place[rows[live[done]]] + steps
            live = live[~done]
            rows[live] = self.step_back(rows[live])
            steps += 1
        return out
