"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 characters (code points, lower-cased, inside and across words). Toxic passages are
short parts of long texts, so a text is read by overlapping windows, and its score is its worst window's. Every window of
every text is scored; nothing is cut off.

Training reads a bounded sample of labelled rows: at most ``per_class`` of each label value, chosen by a hash of the id
among texts of at most ``max_train_chars`` characters. Log-count ratios r come from how many toxic and clean texts hold
each n-gram. A logistic regression on x * r then learns from windows: the worst one of each toxic text, as a toxic text's
label belongs to its worst part, and the worst few of each clean text, chosen anew by each refit. A held-back fifth of
the sample calibrates the scores. The sample's texts stay on the executors: counts of n-grams and chosen windows, a few
hundred numbers each, are all that comes to the driver.

Defined results: a null or empty text scores as one window of spaces; without labels of both values every score is 0;
repeated rows are scored alike; ids may be of any type; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_udf, labelled_sample, prepare, staged, task
from quern.llm.textfeatures import padded_points, platt, point_buckets, sigmoid


@dataclass(frozen=True)
class ToxicityParams:
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    #: Windows are two blocks of so many characters, and overlap by one.
    block: int = 32
    per_class: int = 2000
    max_train_chars: int = 200_000
    #: Windows of a clean text that the fit learns from.
    hard: int = 4
    smoothing: float = 1.0
    ridge: float = 1e-4
    rounds: int = 200
    rate: float = 0.05
    refits: int = 3
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    #: One weight per bucket, r and the regression's multiplied; float32, so 4 * 2^bits bytes whatever the corpus.
    weights: np.ndarray | None
    scale: float = 1.0
    shift: float = 0.0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(sigmoid(self.scale * window_sums(padded_points(text), self.weights, self.params).max() + self.shift))


def window_sums(points: np.ndarray, weights: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """The weight of each window: an n-gram counts in the block where it begins."""
    blocks = -(-len(points) // p.block)
    total = np.zeros(blocks * p.block, np.float32)
    for buckets in point_buckets(points, p.orders, p.bits):
        total[: len(buckets)] += weights[buckets]
    sums = total.reshape(blocks, p.block).sum(axis=1)
    return sums[:-1] + sums[1:] if blocks > 1 else sums


def window_bag(points: np.ndarray, i: int, p: ToxicityParams) -> np.ndarray:
    """The buckets of window i."""
    part = points[i * p.block : (i + 2) * p.block + max(p.orders) - 1]
    return np.concatenate([x[: 2 * p.block] for x in point_buckets(part, p.orders, p.bits)]).astype("<u4")


def text_buckets(text: str | None, p: ToxicityParams) -> np.ndarray:
    """The distinct buckets of a whole text."""
    return np.unique(np.concatenate(point_buckets(padded_points(text), p.orders, p.bits)))


def worst_bags(text: str | None, toxic: bool, weights: np.ndarray, p: ToxicityParams) -> list[np.ndarray]:
    """The windows that a text is learned by: the worst of a toxic one, the worst few of a clean one."""
    points = padded_points(text)
    sums = window_sums(points, weights, p)
    take = [int(sums.argmax())] if toxic else np.argsort(sums, kind="stable")[-p.hard :]
    return [window_bag(points, int(k), p) for k in take]


# ---------------------------------------------------------------- where the sample's texts are


class LocalSample:
    """Texts at hand."""

    def __init__(self, texts: list[str | None], labels: list[int], back: list[bool]):
        self.rows = list(zip(texts, labels, back, strict=True))

    def sizes(self) -> dict[tuple[bool, int], int]:
        out: dict[tuple[bool, int], int] = {}
        for _, y, b in self.rows:
            out[b, y] = out.get((b, y), 0) + 1
        return out

    def counts(self, used, p: ToxicityParams) -> np.ndarray:
        out = np.zeros((2, 1 << p.bits))
        for t, y, b in self.rows:
            if used is None or b == used:
                out[y][text_buckets(t, p)] += 1
        return out

    def windows(self, used, weights: np.ndarray, p: ToxicityParams) -> list[tuple[int, np.ndarray]]:
        return [(y, bag) for t, y, b in self.rows if used is None or b == used for bag in worst_bags(t, y == 1, weights, p)]

    def worst(self, used, weights: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
        own = [(y, window_sums(padded_points(t), weights, p).max()) for t, y, b in self.rows if used is None or b == used]
        return np.array([y for y, _ in own], float), np.array([m for _, m in own], float)


class StagedSample:
    """Texts in a staged table (text, label, back); each pass runs on the executors, over all of the bounded sample."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sizes(self) -> dict[tuple[bool, int], int]:
        return {(r["back"], r["label"]): r["count"] for r in self.rows.groupBy("back", "label").count().collect()}

    def _pass(self, used, run, schema: str) -> pd.DataFrame:
        rows = self.rows if used is None else self.rows.filter(F.col("back") == used)
        return rows.select("text", "label").mapInPandas(task("toxicity", run), schema).toPandas()

    def counts(self, used, p: ToxicityParams) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = np.zeros((2, 1 << p.bits), np.int32)
            for b in batches:
                for t, y in zip(b["text"], b["label"], strict=True):
                    own[y][text_buckets(t, p)] += 1
            yield pd.DataFrame({"data": [zlib.compress(own.tobytes(), 1)]})

        found = [np.frombuffer(zlib.decompress(x), np.int32) for x in self._pass(used, run, "data binary")["data"]]
        return np.sum(found, axis=0, dtype=float).reshape(2, -1) if found else np.zeros((2, 1 << p.bits))

    def windows(self, used, weights: np.ndarray, p: ToxicityParams) -> list[tuple[int, np.ndarray]]:
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(int(y), bag.tobytes()) for t, y in zip(b["text"], b["label"], strict=True) for bag in worst_bags(t, y == 1, shared.value, p)]
                yield pd.DataFrame(out, columns=["label", "bag"])

        found = self._pass(used, run, "label int, bag binary").sort_values(["label", "bag"])
        return [(y, np.frombuffer(x, "<u4")) for y, x in zip(found["label"], found["bag"], strict=True)]

    def worst(self, used, weights: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"label": b["label"], "margin": [float(window_sums(padded_points(t), shared.value, p).max()) for t in b["text"]]})

        found = self._pass(used, run, "label int, margin double").sort_values(["label", "margin"])
        return found["label"].to_numpy(float), found["margin"].to_numpy(float)


# ---------------------------------------------------------------- the fit


def regress(windows: list[tuple[int, np.ndarray]], r: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """Logistic regression on x * r by full steps of Adam, with the two classes weighted alike; r times its weights."""
    y = np.array([t for t, _ in windows], float)
    sizes = np.array([len(b) for _, b in windows])
    used, col = np.unique(np.concatenate([b for _, b in windows]), return_inverse=True)
    row = np.repeat(np.arange(len(y)), sizes)
    x = r[used][col]
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, bias = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, p.rounds + 1):
        z = np.bincount(row, x * w[col], minlength=len(y)) + bias
        g = share * (sigmoid(z) - y)
        grad = np.append(np.bincount(col, x * g[row], minlength=len(used)) + p.ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(len(r))
    out[used] = w
    return out * r


def fit_sample(sample: LocalSample | StagedSample, p: ToxicityParams) -> ToxicityModel:
    sizes = sample.sizes()
    if not all(any(n and y == want for (_, y), n in sizes.items()) for want in (0, 1)):
        return ToxicityModel(p, None)
    # calibration needs both labels on both sides; a sample too small for that is used whole for both
    whole = not all(sizes.get((b, y)) for b in (False, True) for y in (0, 1))
    used, back = (None, None) if whole else (False, True)
    held = sample.counts(used, p) + p.smoothing
    r = np.log((held[1] / held[1].sum()) / (held[0] / held[0].sum()))
    weights = r.astype(np.float32)
    for _ in range(p.refits):
        weights = regress(sample.windows(used, weights, p), r, p).astype(np.float32)
    y, worst = sample.worst(back, weights, p)
    scale, shift = platt(worst, y)
    return ToxicityModel(p, weights, scale, shift)


def fit(texts: list[str | None], labels: list[int], p: ToxicityParams) -> ToxicityModel:
    return fit_sample(LocalSample(texts, labels, [i % 5 == 4 for i in range(len(texts))]), p)


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None, label: str = "toxic", parts: int = 3, held: int = 1) -> ToxicityModel:
    """A model from a bounded sample of the rows outside the held-out fold."""
    p = p or ToxicityParams()
    prepare(docs.sparkSession)
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= p.max_train_chars)
    rows = labelled_sample(short, labels, label, p.per_class, parts, held)
    back = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(5)) == 4
    return fit_sample(StagedSample(staged(rows.select("text", "label", back.alias("back")), "toxicity-sample")), p)


def _scored(docs: DataFrame, model: ToxicityModel, text_col: str):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return column_udf("toxicity", "double", run)(F.coalesce(F.col(text_col), F.lit("")))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """Id and score of every row; a map over the rows, without a shuffle."""
    return docs.select(F.col(id_col), _scored(docs, model, text_col).alias(name))


def flag(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "_toxic") -> DataFrame:
    """The rows with a column that tells whether their text is rejected; a map over the rows."""
    return docs.withColumn(name, _scored(docs, model, text_col) >= model.params.threshold)
