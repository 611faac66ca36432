"""FM-index over a sequence of small integers: suffix order, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence are kept for ``locate``.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by rank doubling; the end of the sequence sorts before every symbol."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] if step < n else rank[:0]
        key = rank * (n + 1) + second
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        rank = fresh
        if rank[order[-1]] == n:
            return order
        step *= 2


class Wavelet:
    """Wavelet tree in matrix form; ``rank`` and ``access`` take whole arrays."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.bits.append(bit.astype(np.int8))
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each position ``upto``."""
        low, high = np.zeros_like(upto), upto
        for k, zeros in enumerate(self.zeros):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            low = np.where(one, zeros[-1] + low - zeros[low], zeros[low])
            high = np.where(one, zeros[-1] + high - zeros[high], zeros[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            bit = bits[at].astype(np.int64)
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros[-1] + at - zeros[at], zeros[at])
        return symbol


class FMIndex:
    """Backward search for many patterns at once, and the places where they occur."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.concatenate((symbols.astype(np.int64) + 1, [0]))
        order = suffix_order(text)
        self.n = len(text)
        self.tree = Wavelet(text[order - 1], sigma + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        self.marked = order % SAMPLE == 0
        self.place = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, which are right-aligned rows of ``patterns``."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((k < lengths) & (low < high))
            symbol = patterns[live, width - 1 - k].astype(np.int64) + 1
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the sequence of each row, by steps back to a sampled one."""
        out, steps = np.empty_like(rows), np.zeros_like(rows)
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.marked[here]
            out[open_[done]] = self.sampled[self.place[here[done]]] + steps[open_[done]]
            open_, here = open_[~done], here[~done]
            symbol = self.tree.access(here)
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, here)
            steps[open_] += 1
        return out
