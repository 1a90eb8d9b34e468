"""Elias-Fano sequences in numpy: sorted numbers in about 2 + log2(range / count) bits each, readable from a mapped file."""

from __future__ import annotations

import json

import numpy as np


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each word's k-th set bit, by halving."""
    out, k = np.zeros(len(word), np.int64), k.astype(np.int64)
    for size in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << size) - 1))
        up = k >= below
        k = k - below * up
        step = up.astype(np.uint8) * np.uint8(size)
        word = word >> step.astype(np.uint64)
        out += step
    return out


def _ones_from(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many set bits follow in a row from each place, and -1 where the row reaches the word's end."""
    rest = ~(words[place >> 6] >> (place & 63).astype(np.uint64))
    n = np.bitwise_count((rest & (np.uint64(0) - rest)) - np.uint64(1)).astype(np.int64)
    return np.where(n + (place & 63) >= 64, -1, n)


def pack(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a sequence of non-decreasing 64-bit numbers."""
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max((top // max(n, 1)).bit_length() - 1, 0)
    high = (values >> np.uint64(width)).astype(np.int64)
    place = high + np.arange(n)
    bits = np.zeros((int(place[-1] if n else 0) // 64 + 3) * 64, np.uint8)
    bits[place] = 1
    upper = np.packbits(bits, bitorder="little").view("<u8")
    lower = np.zeros(n * width // 64 + 2, np.uint64)
    if width and n:
        low = values & np.uint64((1 << width) - 1)
        at = np.arange(n, dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(lower, word, low << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(lower, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)))
    return {"head": np.array([n, width], np.int64), "upper": upper, "lower": lower, "ones": ones}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["head"])
        self.upper, self.lower, self.ones = arrays["upper"], arrays["lower"], arrays["ones"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.lower[word] >> shift
        # a shift by 64 is undefined, so the next word comes in two steps
        out |= (self.lower[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return out & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.upper[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """The place after the k-th zero, counted from 1; 0 for none."""
        j = np.maximum(k - 1, 0)
        word = np.searchsorted(self.zeros, j, side="right") - 1
        return np.where(k > 0, word * 64 + _select_in_word(~self.upper[word], j - self.zeros[word]) + 1, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each number, or -1: a binary search among the numbers with the same upper part."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero(high + 1 < int(self.zeros[-1]))
        high, want = high[inside], (x & np.uint64((1 << self.width) - 1))[inside]
        place = self._after_zero(high)
        run = _ones_from(self.upper, place)
        low = place - high
        if len(long := np.flatnonzero(run < 0)):
            run[long] = self._after_zero(high[long] + 1) - place[long] - 1
        end = low + run
        top = end.copy()
        live = np.flatnonzero(low < end)
        while len(live):
            mid = (low[live] + end[live]) >> 1
            less = self._low(mid) < want[live]
            low[live] = np.where(less, mid + 1, low[live])
            end[live] = np.where(less, end[live], mid)
            live = live[low[live] < end[live]]
        at = np.flatnonzero(low < top)
        hit = at[self._low(low[at]) == want[at]]
        out[inside[hit]] = low[hit]
        return out


# ---------------------------------------------------------------- files of arrays


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block of bytes that can be mapped: a JSON header, then each array at a multiple of 64."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, list(a.shape), at]
        raw += b"\0" * (-len(raw) % 64)
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def load(buffer: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of such a block, as views of the buffer (bytes or a memory map)."""
    size = int.from_bytes(bytes(buffer[:8]), "little")
    base, out = 8 + size, {}
    for name, (kind, shape, at) in json.loads(bytes(buffer[8:base])).items():
        dtype = np.dtype(kind)
        n = int(np.prod(shape)) if shape else 1
        out[name] = np.frombuffer(buffer, dtype, n, base + at).reshape(shape) if n else np.zeros(shape, dtype)
    return out
