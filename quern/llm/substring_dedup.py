"""Substring dedup behind a count-min prefilter.

Every window of ``window`` words that also starts in a document with a smaller id is removed. A window's key is the least
hash of the ``gram``-word stretches inside it, so about one key in twenty words stands for all windows, and equal windows
have equal keys.

1. Each task counts its documents' keys, once a document, in a count-min sketch; the sketches are summed block by block. A
   sketch never counts too low, and a key counts at least as often as any of its windows, so every window that two
   documents share has an estimate of two or more. Only the bits "two or more" come back.
2. A second pass keeps the runs of windows whose key is estimated repeated, as one row each, and groups them exactly by
   key. Where all runs of a key hold the same words, the least id decides for whole runs.
3. Where runs of a key differ, a third pass over their documents groups single windows exactly, by 128-bit hashes.
4. The removed spans of each document join back to it; documents without any pass by.

Size: the sketch has two cells or more for each key of the corpus up to 2^``most_bits`` cells a row (64 MB of bits for
both, at about 17 GB of text). Beyond, it passes more keys that occur once, up to all of them, and the second step is what it would be
without a prefilter: one narrow row for each run of windows, about 0.3 x the text. No window is lost at any size.

Groups are reduced to minima before the shuffle, and minima are written before they join, so that adaptive execution
splits a hot key. No window is dropped and no pair of documents is formed.

Defined results: a null text has no words; a null id counts as larger than all ids; documents of one id do not remove each
other's windows; repeated rows fare alike; an empty table gives an empty result; ids are whole numbers (a TypeError
otherwise); other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_udf, prepare, resident, staged, task, whole_ids
from quern.llm.sketch import BLOCKS, Counter, merged_bits, reached
from quern.llm.wordhash import WordHasher, sliding_min

_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class SubstringParams:
    window: int = 50
    gram: int = 10
    #: Cells of a sketch row as a power of two: by the corpus's size, between these.
    least_bits: int = 16
    most_bits: int = 28
    #: A key for about so many bytes of text, to size the sketch.
    bytes_per_key: int = 128
    #: Up to so many marks of documents (20 MB) are sent to choose texts by; beyond, texts are shuffled to their spans.
    sent: int = 1_000_000


class _Reader:
    """Keys and runs of a text."""

    def __init__(self, p: SubstringParams):
        self.p, self.hasher = p, resident("substring", "hasher", WordHasher)

    def keys(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, and the key of every window."""
        h = self.hasher.hashes(self.hasher.words(text))
        if len(h) < self.p.window:
            return h, np.zeros(0, np.uint64)
        return h, sliding_min(self.hasher.windows(h, self.p.gram), self.p.window - self.p.gram + 1)

    def both(self, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words of each stretch."""
        return self.hasher.spans(h, first, end, 0), self.hasher.spans(h, first, end, 1)


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pd.DataFrame({n: c.view(np.int64) if c.dtype == np.uint64 else c for n, c in zip(names, columns, strict=True)})


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end window of each stretch of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return first, np.concatenate((first[1:], [len(keys)]))


def sketch_keys(rows: DataFrame, p: SubstringParams, bits: int) -> np.ndarray:
    """Bits of the cells that count two or more documents, over the whole corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counter = _Reader(p), Counter(bits)
        for batch in batches:
            for text in batch["_text"]:
                yield from counter.add(np.unique(reader.keys(text)[1]))
        yield from counter.blocks()

    return merged_bits(rows.select("_text").mapInPandas(task("substring", run), BLOCKS), bits, 2)[0]


def _marked(rows: DataFrame, marks: DataFrame, n: int, p: SubstringParams) -> DataFrame:
    """The rows with one of n marks; all rows where the marks are too many to be sent."""
    return rows.join(F.broadcast(marks), "_mark", "left_semi") if n <= p.sent else rows


def removed_spans(docs: DataFrame, p: SubstringParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows as _row (all its columns), _text, and _first, _n: arrays of the removed stretches of words
    (first word, words), null where there are none."""
    p = p or SubstringParams()
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    prepare(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_order"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_print", F.xxhash64("_text")).withColumn("_mark", F.xxhash64("_order", "_print"))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    bits = int(np.clip(int(2 * size / p.bytes_per_key).bit_length(), p.least_bits, p.most_bits))
    repeated = spark.sparkContext.broadcast(sketch_keys(rows, p, bits))

    def emit_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(p)
        for batch in batches:
            out = []
            for order, text_print, text in zip(batch["_order"], batch["_print"], batch["_text"], strict=True):
                h, keys = reader.keys(text)
                first, end = runs_of(keys)
                if not len(first):
                    continue
                keep = reached(repeated.value, keys[first], bits)
                first, end = first[keep], end[keep]
                if len(first):
                    last_word = end + p.window - 1
                    out.append((np.full(len(first), order), np.full(len(first), text_print), keys[first], *reader.both(h, first, last_word), first, last_word - first))
            if out:
                yield _frame(out, ["_order", "_print", "_key", "_a", "_b", "_first", "_n"])

    runs = staged(rows.select("_order", "_print", "_text").mapInPandas(task("substring", emit_runs), "_order long, _print long, _key long, _a long, _b long, _first int, _n int"), "runs")
    body = F.struct("_a", "_b")
    by_key = runs.groupBy("_key").agg(F.min("_order").alias("_least"), F.max("_order").alias("_most"), F.min(body).alias("_low"), F.max(body).alias("_high"))
    by_key = staged(by_key.filter(F.col("_least") < F.col("_most")).select("_key", "_least", (F.col("_low") != F.col("_high")).alias("_mixed")), "keys")
    same = runs.join(by_key.filter(~F.col("_mixed")), "_key").filter(F.col("_order") > F.col("_least")).select("_order", "_print", "_first", "_n")

    # keys whose runs differ, as bits again: exact grouping follows, so a key that shares its cells costs time only
    mixed_keys = by_key.filter("_mixed").select("_key")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(bits)
        for batch in batches:
            yield from counter.add(batch["_key"].to_numpy().view(np.uint64))
        yield from counter.blocks()

    mixed = spark.sparkContext.broadcast(merged_bits(mixed_keys.mapInPandas(task("substring", mark), BLOCKS), bits, 1)[0])
    open_ = staged(runs.join(mixed_keys, "_key", "left_semi").select(F.xxhash64("_order", "_print").alias("_mark")).distinct(), "open")

    def emit_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(p)
        for batch in batches:
            out = []
            for order, text_print, text in zip(batch["_order"], batch["_print"], batch["_text"], strict=True):
                h, keys = reader.keys(text)
                at = np.flatnonzero(reached(mixed.value, keys, bits)) if len(keys) else keys
                if len(at):
                    out.append((np.full(len(at), order), np.full(len(at), text_print), *reader.both(h, at, at + p.window), at))
            if out:
                yield _frame(out, ["_order", "_print", "_a", "_b", "_first"])

    third = _marked(rows, open_, open_.count(), p).select("_order", "_print", "_text")
    windows = staged(third.mapInPandas(task("substring", emit_windows), "_order long, _print long, _a long, _b long, _first int"), "windows")
    least = windows.groupBy("_a", "_b").agg(F.min("_order").alias("_least"), F.max("_order").alias("_most")).filter(F.col("_least") < F.col("_most"))
    # written, so that the join with all windows reads plain shuffles on both sides, which can be split
    least = staged(least.drop("_most"), "least")
    single = windows.join(least, ["_a", "_b"]).filter(F.col("_order") > F.col("_least")).select("_order", "_print", "_first", F.lit(p.window).alias("_n"))
    spans = same.unionByName(single).groupBy("_order", "_print").agg(F.collect_set(F.struct("_first", "_n")).alias("_spans"))
    spans = staged(spans.select("_order", "_print", "_spans", F.xxhash64("_order", "_print").alias("_mark")), "spans")
    marks, n = spans.select("_mark").distinct(), spans.count()
    out = ["_row", "_text", "_spans"]
    joined = _marked(rows, marks, n, p).join(spans.drop("_mark"), ["_order", "_print"], "left").select(*out)
    if n <= p.sent:
        none = F.lit(None).cast(spans.schema["_spans"].dataType)
        joined = joined.unionByName(rows.join(F.broadcast(marks), "_mark", "left_anti").withColumn("_spans", none).select(*out))
    return joined.select("_row", "_text", F.col("_spans._first").alias("_first"), F.col("_spans._n").alias("_n"))


def kept_mask(n_words: int, first, n) -> np.ndarray:
    """True for the words that no removed stretch covers."""
    if first is None or not len(first):
        return np.ones(n_words, bool)
    depth = np.zeros(n_words + 1, np.int64)
    first = np.asarray(first, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + np.asarray(n, np.int64), -1)
    return np.cumsum(depth[:-1]) == 0


def dedup(docs: DataFrame, p: SubstringParams | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Id, n_words, n_removed, kept_sha256, and with keep_text the kept words (the text itself where none is removed)."""
    spans = removed_spans(docs.select(id_col, text_col), p, id_col, text_col)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, sizes in batches:
            out = []
            for text, first, n in zip(texts, firsts, sizes, strict=True):
                words = text.encode("utf-8", "replace").split()
                mask = kept_mask(len(words), first, n)
                kept = b" ".join(words if mask.all() else [words[i] for i in np.flatnonzero(mask)])
                row = (len(words), int(len(words) - mask.sum()), hashlib.sha256(kept).hexdigest())
                out.append(row + ((text if mask.all() else kept.decode("utf-8", "replace"),) if keep_text else ()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    made = column_udf("substring", "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text, run)
    return spans.select(F.col(f"_row.`{id_col}`").alias(id_col), made("_text", "_first", "_n").alias("_m")).select(id_col, "_m.*")


def retext(docs: DataFrame, p: SubstringParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns but the text, _new (the kept words; the text itself, or null, where none is removed) and _changed."""
    spans = removed_spans(docs, p, id_col, text_col)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, firsts, sizes in batches:
            out = []
            for text, first, n in zip(texts, firsts, sizes, strict=True):
                if first is None or not len(first):
                    out.append(None)
                    continue
                words = text.encode("utf-8", "replace").split()
                out.append(b" ".join([words[i] for i in np.flatnonzero(kept_mask(len(words), first, n))]).decode("utf-8", "replace"))
            yield pd.Series(out, dtype=object)

    kept = column_udf("substring", "string", run)
    changed = F.coalesce(F.size("_first") > 0, F.lit(False))
    names = [c for c in docs.columns if c != text_col]
    made = spans.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.col(f"_row.`{text_col}`").alias("_old"), changed.alias("_changed"), kept("_text", "_first", "_n").alias("_kept"))
    return made.select(*[F.col(f"`{c}`") for c in names], F.when(F.col("_changed"), F.col("_kept")).otherwise(F.col("_old")).alias("_new"), "_changed")
