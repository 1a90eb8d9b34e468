"""Language identification by words first, then ever shorter character n-grams, for each language on its own.

A word that a language knows scores there by its log frequency. A language that does not know the word backs off: the word
is read as n-grams of its letters with a mark at both ends, from the longest order down to the first of which the
language knows any, and scores by their mean log frequency a letter, below the language's score of an unseen word and less
a penalty for each step down. So a known word always beats backing off, and one order the next shorter one by the penalty. A
text's score is its languages' softmax over the root-scaled sum of its words.

Training reads a bounded sample: about ``per_language`` texts of each language, by a hash of the id. Counting runs on the
executors; of each language its ``most_entries`` most frequent entries are kept (None: all of them, the exact way), ranked
inside the language. The model is sparse, one number for each kept (entry, language); one of over ``most_bytes`` is
refused with an error, so what goes to the driver and the executors has a proven bound.

Defined results: null, empty and letterless texts are ``und`` with score 0; a null language is not learned from; equal
scores go to the first language in alphabetical order; with nothing to learn from all texts are ``und``; repeated rows
are judged alike; ids may be of any type; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import column_udf, fold, prepare, staged, task

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    per_language: int = 2000
    orders: tuple[int, ...] = (5, 4, 3, 2, 1)
    most_entries: int | None = 60_000
    #: Added to counts.
    smoothing: float = 0.5
    #: Taken off for each step of back-off.
    step_penalty: float = 0.4
    most_languages: int = 400
    #: Entries of the model take about 120 bytes each where they are held.
    most_bytes: int = 400_000_000
    #: Bytes of word scores that a worker keeps.
    cache_bytes: int = 32_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    params: LanguageParams
    languages: list[str]
    #: Order (0: whole words) -> entry -> its languages' numbers and scores, one after the other: for words the log
    #: frequency, for n-grams how far it lies above the floor.
    tables: dict[int, dict[str, tuple]]
    #: Order -> log frequency of an entry that a language does not know.
    floors: dict[int, np.ndarray]
    _steps: list | None = field(default=None, repr=False)
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def steps(self) -> list[tuple[int, dict, list[float]]]:
        """Each step of back-off: its order, its table, and each language's score before its n-grams' gains; at the end order 0
        for languages that know no part of a word."""
        if self._steps is None:
            unseen, p = self.floors[0], self.params
            out = [(n, self.tables[n], unseen + self.floors[n] / n - k * p.step_penalty) for k, n in enumerate(p.orders, 1) if n in self.floors]
            last = (self.floors[out[-1][0]] / out[-1][0]) if out else 0.0
            out.append((0, {}, unseen + last - (len(p.orders) + 1) * p.step_penalty))
            self._steps = [(n, table, [float(x) for x in start]) for n, table, start in out]
        return self._steps

    def word(self, w: str) -> list[float]:
        """The word's score in each language."""
        known = self.tables[0].get(w, ())
        found = dict(zip(known[::2], known[1::2], strict=True))
        size = len(self.languages)
        for n, table, start in self.steps():
            if len(found) == size:
                break
            if not n:
                found |= {k: start[k] for k in range(size) if k not in found}
                break
            grams = grams_of(w, n)
            gains: dict[int, float] = {}
            for g in grams:
                if (own := table.get(g)) is not None:
                    for k in range(0, len(own), 2):
                        gains[own[k]] = gains.get(own[k], 0.0) + own[k + 1]
            for k, gain in gains.items():
                if k not in found:
                    found[k] = start[k] + gain / (len(grams) * n)
        return [found[k] for k in range(size)]

    def _places(self, words: list[str]) -> np.ndarray:
        """Rows of the score table, which grows by the words that it lacks."""
        rows = self._rows
        most = max(1000, self.params.cache_bytes // (8 * len(self.languages)))
        if self._scores is None or len(rows) > most:
            rows.clear()
            self._scores = np.zeros((1024, len(self.languages)))
        if missing := set(words).difference(rows):
            need = len(rows) + len(missing)
            if need > len(self._scores):
                grown = np.zeros((max(need, 2 * len(self._scores)), len(self.languages)))
                grown[: len(rows)] = self._scores[: len(rows)]
                self._scores = grown
            for w in sorted(missing):
                at = rows[w] = len(rows)
                self._scores[at] = self.word(w)
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        at, n = np.unique(self._places(words), return_counts=True)
        total = n @ self._scores[at]
        best = int(total.argmax())
        # a text of many words is surer than its mean word, but words aren't independent
        margin = (total - total[best]) / np.sqrt(len(words))
        return self.languages[best], float(1.0 / np.exp(margin).sum())


def train(docs: DataFrame, p: LanguageParams | None = None, parts: int = 4, held: int = 2) -> LanguageModel:
    p = p or LanguageParams()
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.most_languages + 1).collect()}
    if len(sizes) > p.most_languages:
        raise ValueError(f"more than {p.most_languages} languages; raise most_languages if that is meant")
    if not sizes:
        return LanguageModel(p, [], {}, {})
    unit = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, p.per_language / n) * unit))])
    sample = rows.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lang")), F.lit(unit)) < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, own in words.items():
                for n in (0, *p.orders):
                    table = own if n == 0 else Counter()
                    if n:
                        for w, c in own.items():
                            for g in grams_of(w, n):
                                table[g] += c
                    if table:
                        yield pd.DataFrame({"lang": lang, "n": np.int32(n), "entry": list(table), "c": np.fromiter(table.values(), np.int64, len(table))})

    parts_of = sample.select("lang", "text").mapInPandas(task("language", count), "lang string, n int, entry string, c long")
    counts = staged(parts_of.groupBy("lang", "n", "entry").agg(F.sum("c").alias("c")), "language-counts")
    totals = {(r["lang"], r["n"]): (r["t"], r["k"]) for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("t"), F.count("*").alias("k")).collect()}
    kept = counts
    if p.most_entries is not None:
        # ties go by a hash: the alphabet would set letters beyond ASCII back
        ranked = Window.partitionBy("lang").orderBy(F.desc("c"), F.xxhash64("entry"), F.col("entry"), F.col("n"))
        kept = staged(counts.withColumn("_at", F.row_number().over(ranked)).filter(F.col("_at") <= p.most_entries).drop("_at"), "language-entries")
    if (size := 120 * kept.count()) > p.most_bytes:
        raise ValueError(f"the model would hold about {size} bytes; lower most_entries, or raise most_bytes where executors can hold it")
    found = kept.toPandas().sort_values(["n", "entry", "lang"])
    return build(p, sorted(sizes), found.itertuples(index=False, name=None), totals)


def build(p: LanguageParams, languages: list[str], counts, totals: dict) -> LanguageModel:
    """From rows (language, order, entry, count) and the sums and numbers of entries by (language, order)."""
    number = {lang: i for i, lang in enumerate(languages)}
    orders = sorted({n for _, n in totals})
    scale = {n: np.array([(s := totals.get((lang, n), (0, 0)))[0] + p.smoothing * (s[1] + 1) for lang in languages], float) for n in orders}
    tables: dict[int, dict[str, tuple]] = {n: {} for n in (0, *orders)}
    for lang, n, entry, c in counts:
        at = number[lang]
        own = tables[n]
        log = np.log((c + p.smoothing) / (scale[n][at] if n == 0 else p.smoothing))
        own[entry] = (*own.get(entry, ()), at, float(log))
    return LanguageModel(p, languages, tables, {n: np.log(p.smoothing / scale[n]) for n in orders})


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row; a map over the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shared.value.predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": np.array([x[1] for x in found], float)})

    made = column_udf("language", "lang_pred string, score double", run)(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), made.alias("_made")).select(id_col, "_made.lang_pred", "_made.score")
