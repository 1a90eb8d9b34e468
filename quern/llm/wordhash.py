"""Words of texts as 64-bit hashes, and rolling hashes of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from quern.llm.textfeatures import mix

_BASES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


def _inverse(x: np.uint64) -> int:
    """Of an odd number mod 2^64, by Newton's steps."""
    x, y = int(x), int(x)
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


class _Powers:
    """Powers of a base and of its inverse, grown when a longer text comes."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), _inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64)
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


class WordHasher:
    """ASCII white space parts words; each word's hash is looked up, and computed once while the table holds it."""

    def __init__(self, most: int = 150_000, lower: bool = False):
        self.most, self.lower = most, lower
        self.known = _Table()
        self.powers = [_Powers(b) for b in _BASES]

    def words(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "replace")
        return (raw.lower() if self.lower else raw).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def windows(self, h: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
        """The hash of every window of ``size`` words, by its first word's place."""
        n = len(h)
        if n < size:
            return np.zeros(0, np.uint64)
        return self.spans(h, np.arange(n - size + 1), np.arange(size, n + 1), lane)

    def spans(self, h: np.ndarray, first: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        """The hash of the words first..end-1, equal wherever the same words stand. Two lanes make 128 bits."""
        up, down = self.powers[lane].to(len(h) + 1)
        own = h if lane == 0 else mix(h ^ np.uint64(0xA0761D6478BD642F))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * up[: len(h)], dtype=np.uint64)))
        length = (end - first).astype(np.uint64)
        return mix((sums[end] - sums[first]) * down[first] + length * np.uint64(0xE7037ED1A0B428DB))


class _Table(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, from running minima of blocks to the right and to the left."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
