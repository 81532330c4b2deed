"""An FM-index over integer sequences: suffix ranks, a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and a running count at each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """The number of set bits in front of position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: one bit vector per symbol bit, highest first, zeros stably in front of ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[Bits] = []
        for shift in reversed(range(self.depth)):
            bits = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of its position i."""
        low = np.zeros_like(i)
        for shift, level in zip(reversed(range(self.depth)), self.levels):
            one = (symbol >> shift & 1).astype(bool)
            a, b = level.ones(low), level.ones(i)
            low = np.where(one, level.zeros + a, low - a)
            i = np.where(one, level.zeros + b, i - b)
        return i - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position i, and how often it stands in front of i."""
        low, symbol = np.zeros_like(i), np.zeros_like(i)
        for level in self.levels:
            one = level.get(i).astype(bool)
            symbol = symbol * 2 + one
            a, b = level.ones(low), level.ones(i)
            low = np.where(one, level.zeros + a, low - a)
            i = np.where(one, level.zeros + b, i - b)
        return symbol, i - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes, by prefix doubling. Each 0 counts as a symbol of its own, the earlier the smaller."""
    n = len(text)
    stop = text == 0
    stops = int(stop.sum())
    rank = np.where(stop, np.cumsum(stop) - 1, text.astype(np.int64) + stops)
    width = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - width] = rank[width:] if width < n else []
        order = np.argsort(rank * (n + stops + int(text.max(initial=0)) + 2) + after + 1)
        a, b = rank[order], after[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        np.cumsum(fresh, out=fresh)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if not n or fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Indexes a text of runs of symbols from 1 to ``n_symbols - 1``, each run preceded by a 0, with a 0 at the end.

    Positions are sampled at each start of a run and at every ``sample``-th text position, so a walk
    to the next sample stays within its run.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 16):
        order = suffix_order(text)
        last = text[order - 1]
        self.wavelet = Wavelet(last.astype(np.int64), n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))]).astype(np.int64)
        self.size = len(text)
        kept = (order % sample == 0) | (last == 0)
        self.sampled = Bits(kept.astype(np.uint8))
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval [low, high) of each row of an array of equally long patterns, by backward search."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        live = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[live, column].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = self.smaller[symbol] + both[: len(live)]
            high[live] = self.smaller[symbol] + both[len(live) :]
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows that start with a symbol other than 0."""
        out = np.empty(len(rows), dtype=np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            done = self.sampled.get(at).astype(bool)
            out[live[done]] = self.positions[self.sampled.ones(at[done])] + steps
            live, at = live[~done], at[~done]
            if len(live):
                symbol, before = self.wavelet.access_rank(at)
                at = self.smaller[symbol] + before
            steps += 1
        return out
