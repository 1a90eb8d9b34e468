"""Best-fit packing of tokenised documents into sequences of a fixed length.

Texts are tokenised once and cut into pieces. A plan needs only how many pieces there are of each length, at most
``capacity`` numbers whatever the corpus. On them the driver first fixes sets of up to three pieces that provably dominate
every other way to fill a sequence with their largest piece (Martello and Toth's reduction), and packs the rest by best
fit, longest first. Each piece then finds its place by its rank among the pieces of its length, counted without a
single-task sort: ranks inside (length, bucket) groups plus sums of the groups before.

Texts are coded word by word where the tokenizer allows it, which is tried on probe texts when it is loaded; another
tokenizer gets whole texts.

Defined results: a null text is the empty text, one piece of the end id alone; repeated rows are packed once each; an
empty table gives an empty result; special tokens' strings in a text are ordinary text; ids may be of any type; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import column_udf, prepare, resident, staged, tasks_for


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str
    capacity: int = 2048
    end_id: int = 0
    #: Words in each half of the table that a Python worker keeps.
    cache: int = 120_000
    rows_per_bucket: int = 100_000


#: Where a small letter is followed by a mark that isn't white space, the tokenizer's words end anyway.
_MARK = re.compile(rb"(?<=[a-z])(?=[!-/:-@\[-`{-~])")
_PART = "\x01"
#: Words that the tokenizer's normalizer leaves as they are and its splitter keeps whole: small Latin letters.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


#: A tokenizer whose ids of these, word by word, differ from its ids of the whole is one that looks across words.
_PROBES = (
    "",
    " ",
    "One two  THREE\tfour\n\nfive, six; seven.",
    "it's (a) test: #1 $2 %3 -- end... l'école NÄHE straße ñandú",
    "café é Å 你好 😀 <|endoftext|> x_y z@w 3.14 a1b2",
    "word " * 40 + "unbreakablelowercasewordofsomelength",
)


def _visible() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_VISIBLE = _visible()


class WordCoder:
    """Ids of texts, word by word: the tokenizer never joins what ASCII white space parts, so a word is coded once.

    New words of plain letters go to the tokenizer's model as they are; the others are coded in one string, parted by a
    control character that stands alone, whose ids part the result. The table has two halves: words used since the older half was dropped, and words of before.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        part = self._ids(_PART)
        self.part = int(part[0]) if len(part) == 1 else None
        #: Whether texts may be coded word by word: else each text goes to the tokenizer whole.
        self.by_words = True
        self.by_words = all(own == self._ids(t).tobytes() for t, own in zip(_PROBES, self.encode(list(_PROBES)), strict=True))
        self.known, self.older = {}, {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, text: str | None) -> list[bytes]:
        """Small letters and parted marks give fewer different words; with combining marks near, letters keep their case,
        for the tokenizer composes characters before it lowers them."""
        raw = (text or "").encode("utf-8", "replace")
        if b"\xcc" in raw or b"\xcd" in raw:
            return raw.split()
        return _MARK.sub(b" ", raw.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        new = []
        for w in words.difference(self.known):
            if (ids := self.older.get(w)) is not None:
                self.known[w] = ids
            else:
                new.append(w)
        if len(self.known) + len(new) > self.most:
            self.older, self.known = self.known, {w: x for w in words if (x := self.known.get(w)) is not None}
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in new:
            text = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                shown = text if len(text) == len(w) else w.decode("latin-1").translate(_VISIBLE)
                self.known[w] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            elif self.part is None or _PART in text:
                self.known[w] = self._ids(text).tobytes()
            else:
                rest.append((w, text))
        for at in range(0, len(rest), 20_000):
            own = rest[at : at + 20_000]
            ids = self._ids(f" {_PART} ".join([text for _, text in own]))
            ends = np.flatnonzero(ids == self.part).tolist()
            if len(ends) != len(own) - 1:
                raise ValueError("the tokenizer joins or drops a lone control character")
            raw, last = ids.tobytes(), -1
            for (w, _), end in zip(own, [*ends, len(ids)], strict=True):
                self.known[w] = raw[4 * (last + 1) : 4 * end]
                last = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def pieces(docs: DataFrame, p: PackingParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, piece, start, length, ids_crc32 of every piece; a map over the rows. The id may be of any type."""
    most, end = p.capacity * 4, np.array([p.end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = resident("packing", (p.tokenizer, p.cache), lambda: WordCoder(p.tokenizer, p.cache))
        for texts in batches:
            for at in range(0, len(texts), 256):
                coded = [ids + end for ids in coder.encode(list(texts.iloc[at : at + 256]))]
                sums = [[zlib.crc32(ids[s : s + most]) for s in range(0, len(ids), most)] for ids in coded]
                yield pd.DataFrame({"n": [len(ids) // 4 for ids in coded], "sums": sums})

    coded = column_udf("packing", "n long, sums array<long>", run)(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col), coded.alias("_c")).select(id_col, "_c.n", F.posexplode("_c.sums").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * p.capacity
    return rows.select(id_col, "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(p.capacity)).cast("long").alias("length"), "ids_crc32")


# ---------------------------------------------------------------- the plan, on counts of lengths


class _Stock:
    """Lengths in stock with their counts, and searches over them."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({k: v for k, v in counts.items() if v > 0})
        self.lengths = sorted(self.count)

    def take(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            self.count[x] -= times
            if not self.count[x]:
                del self.count[x]
                self.lengths.remove(x)

    def largest(self, room: int, used: tuple[int, ...] = ()) -> int | None:
        """The largest length of at most room, beside the items in use."""
        i = int(np.searchsorted(self.lengths, room, side="right")) - 1
        while i >= 0 and self.count[self.lengths[i]] <= used.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def smallest(self, n: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The n smallest items, counted with their multiplicity, beside those in use and above a length."""
        out: list[int] = []
        for x in self.lengths[int(np.searchsorted(self.lengths, above, side="right")) :]:
            out += [x] * min(n - len(out), self.count[x] - used.count(x))
            if len(out) >= n:
                break
        return out


def _dominating(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other feasible set with j, or None where none of up to three items is proved."""
    room = capacity - j
    low = stock.smallest(3, (j,))
    fits, total = 0, 0
    for x in low:
        total += x
        fits += total <= room
    if fits == 0:
        return (j,)
    top = stock.largest(room, (j,))
    if fits == 1 or top == room:
        return (j, top)
    if fits == 2:
        best = (0, 0, 0)
        for a in stock.lengths:
            if a >= room:
                break
            if stock.count[a] > (a == j) and (b := stock.largest(min(room - a, a), (j, a))) is not None:
                best = max(best, (a + b, a, b))
        both, a, b = best
        if top >= both:
            return (j, top)
        if top == a:
            above = stock.smallest(2, (j,), above=b)
            if len(above) < 2 or sum(above) > room:
                return (j, a, b)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed (times, lengths), and the counts that are left. Passes repeat until one fixes nothing."""
    stock, fixed, changed = _Stock(counts), [], True
    while changed and stock.lengths:
        changed = False
        for j in stock.lengths[::-1]:
            while stock.count.get(j) and (items := _dominating(stock, j, capacity)):
                times = min(stock.count[x] // items.count(x) for x in set(items))
                fixed.append((times, items))
                stock.take(items, times)
                changed = True
    return fixed, dict(stock.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, on groups of sequences that are filled alike."""
    open_: dict[int, list[tuple[int, tuple]]] = {}  # room left -> groups of (times, linked items)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                for times, k in ((left // per, per), (1, left % per)):
                    if times and k:
                        items: tuple = ()
                        for _ in range(k):
                            items = (length, items)
                        open_.setdefault(capacity - k * length, []).append((times, items))
                break
            times, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(times, left)
            if times > used:
                open_.setdefault(room, []).append((times - used, items))
            open_.setdefault(room - length, []).append((used, (length, items)))
            left -= used
    out = []
    for groups in open_.values():
        for times, items in groups:
            flat = []
            while items:
                flat.append(items[0])
                items = items[1]
            out.append((times, tuple(flat[::-1])))
    return out


@dataclass(frozen=True)
class Plan:
    """Slots sorted by (length, first rank): pieces of ranks first.. go to sequences base.., all at the same offset."""

    keys: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int
    fixed: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (length.astype(np.int64) << 44) + rank
        slot = np.searchsorted(self.keys, want, side="right") - 1
        return self.base[slot] + want - self.keys[slot], self.offset[slot]


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    fixed, rest = reduce_by_dominance(counts, capacity)
    keys, bases, offsets, sequence, ranks = [], [], [], 0, Counter()
    for times, items in fixed + best_fit(rest, capacity):
        at = 0
        for length in items:
            keys.append((length << 44) + ranks[length])
            bases.append(sequence)
            offsets.append(at)
            ranks[length] += times
            at += length
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    pick = lambda x: np.array(x, np.int64)[order]
    return Plan(pick(keys), pick(bases), pick(offsets), sequence, sum(t for t, _ in fixed))


def pack(docs: DataFrame, p: PackingParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    prepare(spark)
    cut = staged(pieces(docs, p, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(make_plan(counts, p.capacity))
    buckets = tasks_for(spark, sum(counts.values()), p.rows_per_bucket)
    marked = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sizes = marked.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = marked.withColumn("_at", F.row_number().over(inside) - 1).join(firsts, ["length", "_bucket"])
    rank = (F.col("_first") + F.col("_at")).alias("_rank")

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, ranks in batches:
            sequence, offset = plan.value.place(length.to_numpy(), ranks.to_numpy())
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    own = [id_col, "piece", "start", "length", "ids_crc32"]
    placed = column_udf("packing", "sequence_id long, offset long", place)("length", rank)
    return ranked.select(*own, placed.alias("_p")).select(*own, "_p.sequence_id", "_p.offset")
