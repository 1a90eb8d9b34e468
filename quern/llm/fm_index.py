"""An FM-index over integer symbols in numpy: wavelet-matrix ranks, backward search, and sampled suffix positions."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Counts of any symbol before any place, by one bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for bit in range(width - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, BitRank(ones), int(len(symbols) - ones.sum())))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit) & 1
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            low = np.where(one == 1, zeros + ones_low, low - ones_low)
            high = np.where(one == 1, zeros + ones_high, high - ones_high)
        return high - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each occurs before its place."""
        symbol, low, high = np.zeros_like(i), np.zeros_like(i), i
        for _, bits, zeros in self.levels:
            one = bits.get(high)
            symbol = symbol << 1 | one
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            low = np.where(one == 1, zeros + ones_low, low - ones_low)
            high = np.where(one == 1, zeros + ones_high, high - ones_high)
        return symbol, high - low


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By doubling; an array whose suffixes all differ within a few symbols takes a few rounds."""
    n, step = len(ranks), 1
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))
        rank[order] = new
        if new[-1] == n:
            return order
        step *= 2


class FMIndex:
    """Over stretches of symbols >= 1. Each stretch ends in a separator of its own, so no match crosses one."""

    def __init__(self, stretches: list[np.ndarray], alphabet: int, sample: int = 8):
        sizes = np.array([len(s) for s in stretches], np.int64)
        #: Where each stretch begins in the joined text.
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1].astype(np.int64)
        n, m = int(sizes.sum() + len(sizes)), len(stretches)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        ends = self.starts + sizes
        inside[ends] = False
        if m:
            text[inside] = np.concatenate(stretches)
        ranks = text + m  # separators are 0 .. m-1 by place, and below all symbols
        ranks[ends] = np.arange(m)
        order = suffix_array(ranks)
        last = text[order - 1]
        self.size = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 1)))).astype(np.int64)
        self.last = WaveletMatrix(last, max(int(alphabet).bit_length(), 1))
        # stretch starts are sampled too: no step leads from them to an earlier place
        marked = (order % sample == 0) | (last == 0)
        self.marked = BitRank(marked)
        self.positions = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of right-aligned phrases (one in each row, its last word in the last column)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows, by steps back to a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, live = rows.copy(), np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.marked.get(here) == 1
            done = live[hit]
            out[done] = self.positions[self.marked.rank(at[done])] + steps[done]
            live = live[~hit]
            symbol, before = self.last.access(at[live])
            at[live] = self.first[symbol] + before
            steps[live] += 1
        return out
