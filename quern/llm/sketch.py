"""A count-min sketch of 64-bit keys over a whole corpus: counts are never too low, and only "this many or more" comes back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.llm.common import task
from quern.llm.textfeatures import mix

_BLOCK = 1 << 16
_SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9))
BLOCKS = "block long, n int, data binary"


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    return [(mix(keys ^ s) >> np.uint64(64 - bits)).astype(np.int64) + (row << bits) for row, s in enumerate(_SEEDS)]


class Counter:
    """A task's own sketch, as its cells that aren't empty: its size goes by the task's keys, not by the sketch's. Counts
    stop at 255. What is held is bounded: beyond it another partial sketch is begun, which merging adds up."""

    def __init__(self, bits: int, most: int = 3_000_000):
        self.bits, self.most = bits, most
        self.held: list[np.ndarray] = []
        self.total = 0
        self.where, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        """Blocks to hand on, if what is held grows beyond its bound."""
        self.held.append(keys)
        self.total += len(keys)
        if self.total > 500_000:
            self._flush()
            if len(self.where) > self.most:
                yield from self.blocks()

    def _flush(self) -> None:
        if self.held:
            cells = np.concatenate(_cells(np.concatenate(self.held), self.bits))
            where, n = np.unique(np.concatenate((cells, self.where)), return_inverse=True)
            self.n = np.bincount(n, np.concatenate((np.ones(len(cells)), self.n)), len(where)).astype(np.int64)
            self.where = where
        self.held, self.total = [], 0

    def blocks(self) -> Iterator[pd.DataFrame]:
        """The cells in packed blocks, one row each."""
        self._flush()
        block = self.where >> 16
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])) if len(block) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low, count = (self.where[a:b] & (_BLOCK - 1)).astype("<u2"), np.minimum(self.n[a:b], 255).astype(np.uint8)
            out.append((int(block[a]), int(b - a), zlib.compress(low.tobytes() + count.tobytes(), 1)))
        self.where, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(out), 500):
            yield pd.DataFrame(out[at : at + 500], columns=["block", "n", "data"])


def merged_bits(partials: DataFrame, bits: int, *least: int) -> list[np.ndarray]:
    """Sums the tasks' blocks; for each of ``least`` the bits of cells that reach it, as one packed array of both rows.

    Blocks meet by number and a task adds them up one block after the other, so it holds one block, however large the
    sketch is and however many partial ones there are. What comes to the driver, in one job, is 2 * 2^bits / 8 bytes a bound at most.
    """
    blocks = (len(_SEEDS) << bits) // _BLOCK
    tasks = min(blocks, int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = partials.repartition(tasks, "block").sortWithinPartitions("block")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cells = -1, np.zeros(_BLOCK, np.int64)

        def done() -> Iterator[pd.DataFrame]:
            for i, bound in enumerate(least):
                if at >= 0 and (hit := cells >= bound).any():
                    yield pd.DataFrame({"level": [i], "block": [at], "data": [np.packbits(hit, bitorder="little").tobytes()]})

        for batch in batches:
            for block, n, data in zip(batch["block"], batch["n"], batch["data"], strict=True):
                if block != at:
                    yield from done()
                    at, cells = int(block), np.zeros(_BLOCK, np.int64)
                raw = zlib.decompress(data)
                cells[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, np.uint8, n, 2 * n)
        yield from done()

    out = [np.zeros((len(_SEEDS) << bits) // 8, np.uint8) for _ in least]
    for r in spread.mapInPandas(task("sketch", add), "level int, block long, data binary").collect():
        out[r["level"]][r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["data"], np.uint8)
    return out


def reached(bits_of: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of each key are set."""
    out = np.ones(len(keys), bool)
    for c in _cells(keys, bits):
        out &= (bits_of[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return out
