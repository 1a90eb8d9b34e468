"""BagMinHash signatures of multisets: two signatures agree in a place with the probability of the weighted Jaccard similarity.

The weights 0, 1, 2, 4, 8 ... cut an element's weight into dyadic intervals (0,1], (1,2], (2,4] ..., each with a Poisson
process whose rate is its length. A point of a process has a time, a signature place, and a level inside the interval,
found by halving the interval as long as bits of a hash say so; an element of weight w sees the points of level at most w.
So all multisets that hold an element see the same points up to their weights. A place of the signature is the earliest
point that falls on it. Times beyond a horizon are never made: it is set so that all places are filled, and doubled in the
rare case that one is not.
"""

from __future__ import annotations

import numpy as np

from quern.llm.textfeatures import mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.uint64(0xC2B2AE3D27D4EB4F)


def _exponential(h: np.ndarray) -> np.ndarray:
    return -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53))


def _intervals(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (seed, interval k, weight) for the intervals that each element reaches into; k covers (2^(k-1), 2^k]."""
    seeds, ks, weights = [mix(h)], [np.zeros(len(h), np.int64)], [weight]
    k = 1
    while (more := weight > (1 << (k - 1))).any():
        seeds.append(mix(h[more] ^ mix(np.full(1, k, np.uint64) * _KIND)))
        ks.append(np.full(int(more.sum()), k, np.int64))
        weights.append(weight[more])
        k += 1
    return np.concatenate(seeds), np.concatenate(ks), np.concatenate(weights)


def signature(h: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """32-bit signature of distinct 64-bit element hashes with whole weights of at least 1."""
    if not len(h):
        return np.zeros(places, np.uint32)
    seed, k, w = _intervals(h, weight)
    rate = np.where(k == 0, 1.0, np.exp2(np.maximum(k - 1, 0)))
    horizon = places * (np.log(places) + 4.0) / float(weight.sum())
    while True:
        first = np.full(places, np.inf)
        time = _exponential(mix(seed + _GOLD)) / rate
        live = np.flatnonzero(time <= horizon)
        time, step = time[live], 1
        while len(live):
            # the point at hand, and as many more as most rows need before the horizon
            ahead = int(1.2 * horizon * rate[live].max()) + 4 if len(live) < 4096 else 1
            steps = np.arange(step, step + ahead, dtype=np.uint64)
            point = seed[live][:, None] + _GOLD * steps
            gaps = _exponential(mix(point[:, 1:])) / rate[live][:, None]
            times = np.concatenate((time[:, None], time[:, None] + np.cumsum(gaps, axis=1)), axis=1)
            seen = times <= horizon
            rows, cols = np.nonzero(seen)
            mark = mix(point[rows, cols] ^ _KIND)
            # halvings of the interval, as the bits below its length; interval 0 has one level
            half = np.int64(1) << np.maximum(k[live][rows] - 1, 0)
            level = np.where(k[live][rows] == 0, 1, half + 1 + ((mark >> np.uint64(32)).astype(np.int64) & (half - 1)))
            held = level <= w[live][rows]
            np.minimum.at(first, ((mark & np.uint64(0xFFFFFFFF)) % np.uint64(places)).astype(np.int64)[held], times[rows, cols][held])
            step += ahead
            nxt = times[:, -1] + _exponential(mix(seed[live] + _GOLD * np.full(1, step, np.uint64))) / rate[live]
            go = nxt <= horizon
            live, time = live[go], nxt[go]
        if np.isfinite(first).all():
            return (mix(first.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        horizon *= 2


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The weighted Jaccard similarity of two multisets of sorted distinct hashes."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[ia], wb[ib]).sum())
    total = float(wa.sum() + wb.sum()) - both
    return both / total if total else 0.0
