"""Quality from trusted positives and unlabelled text: a linear model of least non-negative unbiased risk.

Trusted positives are training documents labelled 1; unlabelled text is any training document, whatever its label. No
negative label is read. The class prior is estimated from the two samples: a first classifier of positive against
unlabelled orders the texts, and the share of unlabelled texts among the best-ordered, over the same share of positives,
is bounded from above at the cut where the bound is tightest. The model then minimises

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

with the logistic loss by mini-batches; where the bracket is negative the step reverses it.

Features of a whole text: frequencies of 1- to 3-grams over character classes (letters by case, digits, marks as they
are), hashed, and a few ratios: repeated lines, repeated words, length, mean word. Both samples are bounded parameters, by
a hash of the id, among texts of at most ``max_train_chars`` characters.

Defined results: a null text is the empty text; without positives or unlabelled texts every score is 0; repeated rows are
scored alike; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_udf, hashed_sample, labelled_sample, prepare
from quern.llm.textfeatures import ngram_buckets, sigmoid


@dataclass(frozen=True)
class QualityParams:
    bits: int = 11
    orders: tuple[int, ...] = (1, 2, 3)
    positives: int = 3000
    unlabelled: int = 6000
    max_train_chars: int = 200_000
    epochs: int = 150
    batch: int = 256
    rate: float = 0.02
    ridge: float = 1e-5
    #: Slack of the prior's bound: confidence that both shares hold.
    delta: float = 0.1
    threshold: float = 0.7


def _classes() -> np.ndarray:
    """Byte -> class: small and capital letters, digits and bytes above ASCII fold together; marks stay themselves."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    t[128:] = ord("a")
    return t


_CLASS = _classes()
N_RATIOS = 8


def features(text: str | None, p: QualityParams) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    b = _CLASS[np.frombuffer(b"\n" + raw + b"\n", np.uint8)]
    out = np.zeros((1 << p.bits) + N_RATIOS, np.float32)
    for buckets in ngram_buckets(b, p.orders, p.bits):
        if len(buckets):
            out[: 1 << p.bits] += np.bincount(buckets, minlength=1 << p.bits) / len(buckets)
    np.sqrt(out, out=out)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    out[1 << p.bits :] = (
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        1 - len(seen) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        min(np.log1p(len(words)) / 8, 2),
        min(len(raw) / n / 10, 3),
        float(len(words) < 20),
        sum(len(w) > 20 for w in words) / n,
        max(seen.values(), default=0) / n,
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    weights: np.ndarray | None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    bias: float = 0.0
    prior: float = 0.0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = (features(text, self.params) - self.mean) / self.spread
        return float(sigmoid(x @ self.weights + self.bias))


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float) -> float:
    """The share of positives among the unlabelled, from classifier outputs on held-back samples of both."""
    cuts = np.unique(np.quantile(pos, np.linspace(0, 0.99, 200)))
    q_p = np.array([(pos >= c).mean() for c in cuts])
    q_u = np.array([(unl >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2 / len(unl)) + np.sqrt(np.log(4 / delta) / 2 / len(pos))
    bound = (q_u + slack) / np.maximum(q_p, 1e-9)
    best = int(bound.argmin())
    return float(np.clip(q_u[best] / max(q_p[best], 1e-9), 0.02, 0.98))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, p: QualityParams, epochs: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; with no prior, plain positive against unlabelled."""
    dim = xp.shape[1]
    w, m, v, t = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1), 0
    rng = np.random.default_rng(0)
    xp, xu = np.hstack([xp, np.ones((len(xp), 1))]), np.hstack([xu, np.ones((len(xu), 1))])
    for _ in range(epochs):
        order = rng.permutation(len(xu))
        for at in range(0, len(order), p.batch):
            u = xu[order[at : at + p.batch]]
            q = xp[rng.integers(0, len(xp), p.batch)]
            zp, zu = q @ w, u @ w
            g_pos = -((1 - sigmoid(zp)) @ q) / len(q)  # of l(+) on positives
            g_pos_neg = (sigmoid(zp) @ q) / len(q)  # of l(-) on positives
            g_unl = (sigmoid(zu) @ u) / len(u)  # of l(-) on unlabelled
            if prior is None:
                grad = g_pos + g_unl
            else:
                rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                grad = prior * g_pos + g_unl - prior * g_pos_neg if rest >= 0 else prior * g_pos_neg - g_unl
            grad[:-1] += p.ridge * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(pos: np.ndarray, unl: np.ndarray, p: QualityParams) -> QualityModel:
    """From feature rows of trusted positives and of unlabelled texts."""
    if len(pos) < 4 or len(unl) < 4:
        return QualityModel(p, None)
    mean, spread = unl.mean(axis=0), unl.std(axis=0) + 1e-2
    pos, unl = (pos - mean) / spread, (unl - mean) / spread
    w, b = _descend(pos[::2], unl[::2], None, p, max(p.epochs // 5, 1))
    prior = class_prior(pos[1::2] @ w + b, unl[1::2] @ w + b, p.delta)
    w, b = _descend(pos, unl, prior, p, p.epochs)
    return QualityModel(p, w.astype(np.float32), mean, spread, b, prior)


def _featured(rows: DataFrame, p: QualityParams) -> np.ndarray:
    """Feature rows of a bounded sample, made on the executors, in one order whatever the partitions."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t, p).astype(np.float16).tobytes() for t in texts], dtype=object)

    made = rows.select(F.col("doc_id").cast("string").alias("key"), column_udf("quality", "binary", run)("text").alias("x"))
    found = made.toPandas().sort_values(["key", "x"])
    if not len(found):
        return np.zeros((0, (1 << p.bits) + N_RATIOS), np.float32)
    return np.stack([np.frombuffer(x, np.float16) for x in found["x"]]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, p: QualityParams | None = None, label: str = "quality", parts: int = 4, held: int = 2) -> QualityModel:
    p = p or QualityParams()
    prepare(docs.sparkSession)
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= p.max_train_chars)
    positives = labelled_sample(short, labels.filter(F.col(label) == 1), label, p.positives, parts, held)
    unlabelled = hashed_sample(short, p.unlabelled, parts, held, "unlabelled")
    return fit(_featured(positives, p), _featured(unlabelled, p), p)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """Id and score of every row; a map over the rows. The id may be of any type."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.select(F.col(id_col), column_udf("quality", "double", run)(F.coalesce(F.col(text_col), F.lit(""))).alias(name))
