"""Vectorised features of texts in numpy: hashed byte n-grams, without a Python loop over characters."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _MUL
    return h ^ (h >> np.uint64(32))


def padded_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased and a space at either end; null is the empty text."""
    return np.frombuffer(b" " + (text or "").encode("utf-8", "replace").lower() + b" ", np.uint8)


def padded_points(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with a space at either end; null is the empty text."""
    return np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), "<u4")


def point_buckets(points: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order n, the bucket of every n-gram of code points, in order of place."""
    out, own, rolled, length = [], points.astype(np.uint64), points.astype(np.uint64), 1
    for n in sorted(orders):
        while length < n:
            rolled = rolled[:-1] * _MUL + own[length:] if len(own) > length else rolled[:0]
            length += 1
        h = (rolled ^ np.uint64(n)) * _MUL
        out.append(((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64))
    return out


def ngram_buckets(b: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order n of up to 8, the bucket of every n-gram of bytes, in order of place."""
    out, packed, length = [], b.astype(np.uint64), 1
    for n in sorted(orders):
        while length < n:
            packed = (packed[:-1] << np.uint64(8)) | b[length:] if len(b) > length else packed[:0]
            length += 1
        h = (packed ^ np.uint64(n)) * _MUL
        out.append(((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64))
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) fits y: Newton steps on the log loss with a weak prior on a = 1."""
    scale = max(float(np.std(margins)), 1e-9)
    m, a, b = margins / scale, 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * m + b)
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-3 * b])
        hess = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return a / scale, b
