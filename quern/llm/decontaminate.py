"""Benchmark decontamination with an FM-index for each shard of training texts.

A shard is a run of documents inside a task, of about ``shard_words`` words. Its words become symbols: a word that no
benchmark phrase holds ends a stretch, for no match can cross it, and stretches shorter than the shortest phrase are left
out of the index, for none fits in. So the index holds the stretches of benchmark words of every document whole, and
nothing else: of a corpus in another vocabulary next to nothing, with a one-word item in the benchmark each occurrence of
any benchmark word. The index is searched for all phrases at once, backwards through wavelet-matrix ranks; occurrences are
located by sampled suffix positions and merged into removal spans of word places.

Phrases are all windows of ``window`` words of an item; an item of fewer words, but not none, is one phrase. They go to the
tasks in blocks of about ``block_phrases``, or one item where it alone has more, so no task holds a benchmark of unknown
size. A usual benchmark is one block, and the search a map over the rows; each further block reads the documents once more
and writes the hits alone, which join the texts by their digest.

Defined results: null texts have no words; repeated rows are judged row by row, repeated items count once by item_id; an
item with a null item_id has no name, so its passages are hit and cut out, but it enters no items; an empty benchmark
leaves every document clean; ids and all other columns stay as they are, whatever their types; other columns of the
benchmark are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_udf, prepare, staged
from quern.llm.fm_index import FMIndex

#: The words of a text before its capitals are folded.
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _fold_table() -> bytes:
    """Bytes outside words become spaces, A-Z small letters; bytes above ASCII stay."""
    t = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        t[i] = ord(c.lower()) if c.isalnum() else 32
    return bytes(t)


_FOLD = _fold_table()


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    shard_words: int = 1_000_000
    sample: int = 8
    block_phrases: int = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Phrases:
    """The distinct phrases of some items, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.symbol: dict[bytes, int] = {}
        found: dict[bytes, tuple[str, ...]] = {}
        alike: dict[tuple[str, ...], tuple[str, ...]] = {}
        for item, text in items:
            ids = np.array([self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)], np.int32)
            for i in range(max(len(ids) - window + 1, 1) if len(ids) else 0):
                key = ids[i : i + window].tobytes()
                own = found.get(key, ())
                names = tuple(sorted({*own, item})) if item is not None else own
                found[key] = alike.setdefault(names, names)
        self.items = list(found.values())
        self.lengths = np.array([len(k) // 4 for k in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.table = np.zeros((len(found), window), np.int32)
        for row, k in enumerate(found):
            self.table[row, window - len(k) // 4 :] = np.frombuffer(k, np.int32)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The words' symbols, 0 for those of no phrase."""
        return np.fromiter(map(self.symbol.get, words, repeat(0)), np.int32, len(words))


def shard_hits(docs: list[np.ndarray], phrases: Phrases, sample: int) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each document of a shard, given as symbols: merged spans of word places as rows (start, end), and the items that occur."""
    spans = [np.zeros((0, 2), np.int64)] * len(docs)
    items: list[set[str]] = [set() for _ in docs]
    if not len(phrases.lengths) or not docs:
        return spans, items
    sizes = np.array([len(d) for d in docs], np.int64)
    symbols = np.concatenate(docs).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))  # of each document's words in the shard
    known = np.concatenate(([0], symbols > 0, [0])).astype(np.int8)
    known_at = np.flatnonzero(np.diff(known))
    first, end = known_at[::2], known_at[1::2]
    # a stretch also ends with its document
    inner = np.unique(base[1:-1])
    inner = inner[np.searchsorted(first, inner, side="right") > 0]
    holder = np.searchsorted(first, inner, side="right") - 1
    inner = inner[(inner > first[holder]) & (inner < end[holder])] if len(inner) else inner
    first, end = np.sort(np.concatenate((first, inner))), np.sort(np.concatenate((end, inner)))
    fits = end - first >= phrases.shortest
    first, end = first[fits], end[fits]
    if not len(first):
        return spans, items
    index = FMIndex([symbols[a:b] for a, b in zip(first, end, strict=True)], len(phrases.symbol), sample)
    low, high = index.search(phrases.table, phrases.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    place = index.locate(rows)
    stretch = np.searchsorted(index.starts, place, side="right") - 1
    start = first[stretch] + place - index.starts[stretch]
    doc = np.searchsorted(base, start, side="right") - 1
    depth = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + phrases.lengths[phrase], -1)
    hit = np.concatenate(([0], np.cumsum(depth[:-1]) > 0, [0])).astype(np.int8)
    for d in np.unique(doc):
        own = hit[base[d] : base[d + 1] + 2].copy()
        own[0] = own[-1] = 0
        spans[d] = np.flatnonzero(np.diff(own)).reshape(-1, 2)
    for d, k in np.unique(np.stack((doc, phrase)), axis=1).T if len(doc) else ():
        items[d].update(phrases.items[k])
    return spans, items


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return a if len(a) else b
    both = np.concatenate((a, b))
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.concatenate(([True], both[1:, 0] > reach[:-1]))
    return np.stack((both[new, 0], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(both) - 1]))]), axis=1)


def _search(phrases, p: DecontaminationParams, texts: Column, keep_text: bool) -> Column:
    """n_words, n_hit, spans, items, and with keep_text the text without its spans where it has any."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = phrases.value

        def flush(rows: list[str], docs: list[np.ndarray]) -> pd.DataFrame:
            spans, found = shard_hits(docs, own, p.sample)
            out = {
                "n_words": [len(d) for d in docs],
                "n_hit": [int((s[:, 1] - s[:, 0]).sum()) for s in spans],
                "spans": [s.ravel().tolist() for s in spans],
                "items": [sorted(x) for x in found],
            }
            if keep_text:
                out["new"] = [cut(t, s.ravel().tolist()) if len(s) else None for t, s in zip(rows, spans, strict=True)]
            return pd.DataFrame(out)

        rows, held, total = [], [], 0
        for batch in batches:
            for text in batch:
                rows.append(text if keep_text else "")
                held.append(own.symbols(words_of(text)))
                total += len(held[-1])
                if total >= p.shard_words:
                    yield flush(rows, held)
                    rows, held, total = [], [], 0
        if rows:
            yield flush(rows, held)

    return column_udf("decontamination", "n_words long, n_hit long, spans array<long>, items array<string>" + ", new string" * keep_text, run)(texts)


def _blocks(benchmark: DataFrame, p: DecontaminationParams) -> list:
    """The phrases of each block, as broadcasts."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD.pattern))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(words) // p.block_phrases))
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in own.collect()], p.window))


def found_in(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams, text_col: str, keep_text: bool) -> DataFrame:
    """The rows of docs with a column _found: n_words, n_hit, spans, items, and new with keep_text."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = list(_blocks(benchmark, p))
    if len(blocks) == 1:
        return docs.withColumn("_found", _search(blocks[0], p, text, keep_text))
    hits = []
    for block in blocks:
        made = docs.select(F.sha2(text, 256).alias("_text_key"), _search(block, p, text, False).alias("f"))
        hits.append(staged(made.filter("f.n_hit > 0").select("_text_key", "f.spans", "f.items").dropDuplicates(["_text_key"]), "hits"))
    both = reduce(DataFrame.union, hits).groupBy("_text_key").agg(F.collect_list("spans").alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))

    def merge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for t, several in zip(texts, spans, strict=True):
                own = np.zeros((0, 2), np.int64)
                for x in several if several is not None else ():
                    own = _merge(own, np.asarray(x, np.int64).reshape(-1, 2))
                flat = own.ravel().tolist()
                row = (len(words_of(t)), int((own[:, 1] - own[:, 0]).sum()), flat)
                out.append(row + ((cut(t, flat) if flat else None,) if keep_text else ()))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "spans"] + ["new"] * keep_text)

    merged = column_udf("decontamination", "n_words long, n_hit long, spans array<long>" + ", new string" * keep_text, merge)
    rows = docs.withColumn("_text_key", F.sha2(text, 256)).join(both, "_text_key", "left")
    rows = rows.withColumn("_m", merged(text, F.col("_spans")))
    fields = [F.col(f"_m.{c}").alias(c) for c in ("n_words", "n_hit", "spans")] + [F.coalesce("_items", F.array().cast("array<string>")).alias("items")] + [F.col("_m.new").alias("new")] * keep_text
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*fields).alias("_found"))


def find(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_words, n_hit, spans (flat array of start, end, start, end ...), items (sorted texts)."""
    own = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    out = found_in(own, benchmark, p or DecontaminationParams(), "_text", False)
    return out.select(id_col, "_found.n_words", "_found.n_hit", "_found.spans", "_found.items")


def cut(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: counts and a hash of the items."""
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def retext(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams | None = None, text_col: str = "text") -> DataFrame:
    """The input's columns but the text, _new (the text without its spans; null stays null) and _changed."""
    found = found_in(docs, benchmark, p or DecontaminationParams(), text_col, True)
    names = [c for c in docs.columns if c != text_col]
    changed = F.col("_found.n_hit") > 0
    return found.select(*[F.col(f"`{c}`") for c in names], F.when(changed, F.col("_found.new")).otherwise(F.col(text_col)).alias("_new"), changed.alias("_changed"))
