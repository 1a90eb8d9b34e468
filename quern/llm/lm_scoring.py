"""Language-model scoring with an Elias-Fano trie of word n-grams.

Training counts words, pairs and triples over every training document. The trie has three levels, each in shards that tasks
write to the folder all executors share and later tasks map into memory:

1. words by their 64-bit hashes as an Elias-Fano sequence, with counts of one byte and a list of the larger ones; a word's
   id is its rank;
2. pairs (u, w) seen ``min_count`` times or more (all by default), in order of u then w, as one Elias-Fano sequence a shard, with the
   pointers to where each u's successors begin as another;
3. triples (u, v, w): the node of (u, v), then the rank of w among the successors of v, as Elias-Fano sequences. A triple is
   found by looking up (u, v) and (v, w) in level 2 and then the relative rank below the node.

Probabilities are interpolated by absolute discounting: what a context takes off its kept successors, and all that its
dropped ones had, goes to the shorter context; words end in add-one estimates over the vocabulary and one unknown word. So
every context's probabilities sum to one, up to the quantisation of logarithms to 1/4096.

Sizes: a task counts in blocks of ``block_tokens``, sorted and packed before the shuffle; shards are by size of the corpus
and built one after the other in a task; the driver sees one row of totals a shard. A word's successors lie in one shard, so
the largest shard grows with the successors of the most frequent word. Keys are 64-bit numbers; a corpus with more words
or pairs than they can tell apart is refused with an error.

Defined results: a null or empty text is the end token alone; without training documents all words are unknown and every
score is 0; repeated rows count and score each; words whose 64-bit hashes are equal are one word; ids may
be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import column_udf, new_folder, prepare, resident, staged, task
from quern.llm.elias_fano import EliasFano, dump, load, pack
from quern.llm.wordhash import WordHasher

_END = b""
_STEP = 4096.0


@dataclass(frozen=True)
class LmParams:
    min_count: int = 1
    discount: float = 0.5
    block_tokens: int = 1_000_000
    #: Text bytes for each shard of words, of pairs and of triples: by how many distinct ones a byte brings.
    shard_bytes: tuple[int, int, int] = (128_000_000, 32_000_000, 12_000_000)
    least_shards: int = 8


# ---------------------------------------------------------------- files


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    from pyarrow.fs import FileSystem, FileType
    from pyspark import TaskContext

    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(attempt, compression=None) as out:
        out.write(dump(arrays))
    try:
        fs.move(attempt, f"{root}/{name}")
    except OSError:
        # an earlier attempt has moved the same shard there, and the store doesn't replace files
        if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
            raise
        fs.delete_file(attempt)


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """A file's arrays: mapped where the folder is a mounted one, else read."""
    from pyarrow.fs import FileSystem, FileType, LocalFileSystem

    fs, root = FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type == FileType.NotFound:
        return {}
    if isinstance(fs, LocalFileSystem):
        return load(np.memmap(path, np.uint8, "r"))
    with fs.open_input_stream(path) as f:
        return load(np.frombuffer(f.read(), np.uint8))


# ---------------------------------------------------------------- counted keys, block by block


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _rows(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
    """Sorted keys and counts as one packed row for each shard; shards rise with keys."""
    codec = zstandard.ZstdCompressor(level=1)
    cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        gaps = np.diff(keys[a:b], prepend=np.zeros(1, np.uint64))
        planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)  # like bytes together pack better
        few = np.minimum(counts[a:b], 255).astype(np.uint8)
        many = counts[a:b][few == 255].astype(np.int64)
        out.append((int(shard[a]), int(b - a), codec.compress(planes.tobytes() + few.tobytes() + many.tobytes())))
    return pd.DataFrame(out, columns=["shard", "n", "data"])


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    counts = np.frombuffer(raw, np.uint8, n, 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, -1, 9 * n)
    return keys, counts


_PACKED = "shard int, n int, data binary"


def _built(packed: DataFrame, shards: int, build, schema: str) -> DataFrame:
    """Runs ``build(shard, keys, counts)`` once a shard over the sums of its packed rows, one shard after the other."""
    spread = packed.repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, size = -1, [], 0
        for batch in batches:
            for shard, n, data in zip(batch["shard"], batch["n"], batch["data"], strict=True):
                if shard != at:
                    if own:
                        yield build(at, *_merged(own))
                    at, own, size = int(shard), [], 0
                own.append(_unpacked(n, data))
                size += n
                if size > 1_000_000 and len(own) > 1 and size > 2 * len(own[0][0]):
                    own[:] = [_merged(own)]
                    size = len(own[0][0])
        if own:
            yield build(at, *_merged(own))

    return staged(spread.mapInPandas(task("lm", run), schema), "levels")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class LmModel:
    folder: str
    #: How many shards each level has.
    shards: tuple[int, int, int]
    discount: float
    #: First word id and first level-2 index of each shard; tokens, documents, largest number of successors.
    words: tuple[int, ...] = ()
    pairs: tuple[int, ...] = ()
    n_tokens: int = 0
    n_docs: int = 0
    fanout: int = 1

    @property
    def n_words(self) -> int:
        return self.words[-1] if self.words else 0

    @property
    def start(self) -> int:
        """The id that stands before a text's first word."""
        return self.n_words

    @property
    def unknown(self) -> int:
        return self.n_words + 1

    @property
    def span(self) -> int:
        return self.n_words + 2

    @property
    def id_type(self) -> str:
        """Word ids as they are stored: four bytes as long as they fit."""
        return "<i4" if self.span < 1 << 31 else "<i8"

    def check(self) -> None:
        """Keys of pairs and triples are 64-bit numbers."""
        if self.span**2 >= 1 << 63:
            raise OverflowError(f"{self.n_words} distinct words are too many for 64-bit pair keys")
        if self.pairs and self.pairs[-1] * self.fanout >= 1 << 63:
            raise OverflowError(f"{self.pairs[-1]} pairs of up to {self.fanout} successors are too many for 64-bit triple keys")

    def shard_of(self, context: np.ndarray) -> np.ndarray:
        """Level-2 shard of a context word: equal stretches of ids."""
        return context * self.shards[1] // self.span

    def shard_of_pair(self, pair: np.ndarray) -> np.ndarray:
        return pair * self.shards[2] // max(self.pairs[-1], 1)

    # -------- level 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids of hashes."""
        own, back = np.unique(h, return_inverse=True)
        out = np.full(len(own), self.unknown, np.int64)
        if self.n_words:
            n = self.shards[0]
            cut = np.searchsorted(own, _hash_cuts(n))
            for s in range(n):
                a, b = cut[s], cut[s + 1] if s + 1 < n else len(own)
                if b > a and (f := _level(self.folder, f"words-{s}")) is not None:
                    at = f["h"].find(own[a:b])
                    out[a:b] = np.where(at >= 0, at + self.words[s], self.unknown)
        return out[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of word ids; of the start id the number of documents, of unknown words 0."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.words, ids, side="right") - 1
        for s, own in _groups(shard):
            if 0 <= s < self.shards[0]:
                out[own] = _count_at(_level(self.folder, f"words-{s}"), ids[own] - self.words[s])
        out[ids == self.start] = self.n_docs
        out[ids == self.unknown] = 0
        return out

    def log_word(self, ids: np.ndarray) -> np.ndarray:
        """log10 of add-one probabilities."""
        return np.log10((self.counts(ids) + 1) / (self.n_tokens + self.n_words + 1))

    # -------- level 2

    def find_pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Level-2 index of each pair, or -1."""
        out = np.full(len(u), -1, np.int64)
        shard = self.shard_of(u)
        for s, own in _groups(shard):
            if (f := _level(self.folder, f"pairs-{s}")) is not None:
                at = f["keys"].find((u[own].astype(np.uint64) - np.uint64(f["base"])) * np.uint64(self.span) + w[own].astype(np.uint64))
                out[own] = np.where(at >= 0, at + self.pairs[s], -1)
        return out

    def _by(self, shard: np.ndarray, n: int, level: str, read) -> np.ndarray:
        out = np.zeros(n)
        for s, own in _groups(shard):
            if (f := _level(self.folder, f"{level}-{s}")) is not None:
                out[own] = read(f, own, s)
        return out

    def pair_shard(self, pair: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, pair, side="right") - 1

    def log_pair(self, pair: np.ndarray) -> np.ndarray:
        return self._by(self.pair_shard(pair), len(pair), "pairs", lambda f, own, s: f["q"][pair[own] - self.pairs[s]] / -_STEP)

    def pair_count(self, pair: np.ndarray) -> np.ndarray:
        return self._by(self.pair_shard(pair), len(pair), "pairs", lambda f, own, s: _count_at(f, pair[own] - self.pairs[s]))

    def second(self, pair: np.ndarray) -> np.ndarray:
        """The second word of each pair."""
        return self._by(self.pair_shard(pair), len(pair), "pairs", lambda f, own, s: (f["keys"].access(pair[own] - self.pairs[s]) % np.uint64(self.span)).astype(np.int64)).astype(np.int64)

    def log_left(self, u: np.ndarray) -> np.ndarray:
        """log10 of what a context word leaves to the words alone; a context without kept successors leaves all."""
        return self._by(self.shard_of(u), len(u), "pairs", lambda f, own, s: f["left"][u[own] - f["base"]] / -_STEP)

    def first_pair(self, u: np.ndarray) -> np.ndarray:
        """Where each word's successors begin in level 2."""
        return self._by(self.shard_of(u), len(u), "pairs", lambda f, own, s: f["pointers"].access(u[own] - f["base"]).astype(np.int64) + self.pairs[s]).astype(np.int64)

    # -------- level 3

    def find_triples(self, node: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, log10 probability) of the successor of a rank below each level-2 node."""
        out, hit = np.zeros(len(node)), np.zeros(len(node), bool)
        shard = self.shard_of_pair(node)
        for s, own in _groups(shard):
            if (f := _level(self.folder, f"triples-{s}")) is not None:
                at = f["keys"].find((node[own].astype(np.uint64) - np.uint64(f["base"])) * np.uint64(self.fanout) + rank[own].astype(np.uint64))
                found = at >= 0
                hit[own] = found
                out[own[found]] = f["q"][at[found]] / -_STEP
        return hit, out

    def log_left_pair(self, node: np.ndarray) -> np.ndarray:
        return self._by(self.shard_of_pair(node), len(node), "triples", lambda f, own, s: f["left"][node[own] - f["base"]] / -_STEP)

    # -------- texts

    def score(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 base probability, known) of each token; first marks the tokens that begin a text."""
        own, back = np.unique(ids, return_inverse=True)
        word = self.log_word(own)
        base, known = word[back], (self.counts(own) > 0)[back]
        if not self.n_words:
            return base, base, known
        u = np.concatenate(([self.start], ids[:-1]))
        u[first] = self.start
        key, back = np.unique(u * self.span + ids, return_inverse=True)
        pu, pw = np.divmod(key, self.span)
        pair = self.find_pairs(pu, pw)
        hit = pair >= 0
        two = np.zeros(len(key))
        two[hit] = self.log_pair(pair[hit])
        two[~hit] = self.log_left(pu[~hit]) + word[np.searchsorted(own, pw[~hit])]
        ranks = np.zeros(len(key), np.int64)
        ranks[hit] = pair[hit] - self.first_pair(pu[hit])
        pair, out, ranks = pair[back], two[back], ranks[back]
        node = np.concatenate(([-1], pair[:-1]))
        node[first] = -1
        has = np.flatnonzero(node >= 0)
        out[has] += self.log_left_pair(node[has])
        both = has[pair[has] >= 0]
        both = both[np.argsort(node[both])]  # neighbours in the trie are read together
        found, three = self.find_triples(node[both], ranks[both])
        out[both[found]] = three[found]
        return out, base, known


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places that have it, in one sort whatever the number of shards."""
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.int16) if shard.max(initial=0) < 1 << 15 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for own in np.split(order, cuts):
        yield int(shard[own[0]]), own


def _hash_cuts(shards: int) -> np.ndarray:
    """The least hash of each shard of words, from the first on."""
    return np.array([((s << 64) + shards - 1) // shards for s in range(shards)], np.uint64)


def _level(folder: str, name: str) -> dict | None:
    """A shard of level 2 or 3 with its sequences ready, or None where it was not written."""
    return resident("lm", (folder, name, "level"), lambda: _ready(_mapped(folder, name)))


def _ready(arrays: dict[str, np.ndarray]) -> dict | None:
    if not arrays:
        return None
    sequence = lambda name: EliasFano({k[len(name) + 1 :]: v for k, v in arrays.items() if k.startswith(name + ".")})
    out: dict = {"base": int(arrays["base"][0])}
    out |= {name: sequence(name) for name in ("keys", "pointers", "h") if f"{name}.head" in arrays}
    return out | {k: v for k, v in arrays.items() if "." not in k and k != "base"}


def _sequence(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in pack(values).items()}


def _counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """One byte a count; counts of 255 and more stand in a list of their own, by place."""
    many = np.flatnonzero(counts >= 255)
    return {"few": np.minimum(counts, 255).astype(np.uint8), "where": many.astype(np.int64), "many": counts[many].astype(np.int64)}


def _count_at(f: dict, at: np.ndarray) -> np.ndarray:
    out = f["few"][at].astype(np.int64)
    if len(over := np.flatnonzero(out == 255)):
        out[over] = f["many"][np.searchsorted(f["where"], at[over])]
    return out


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * _STEP), 0, 65535).astype(np.uint16)


def _left(kept: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log10 of the share that contexts leave: all but the discounted counts of kept successors."""
    return np.log10(np.clip(1 - kept / np.maximum(total, 1), 1e-12, 1))


# ---------------------------------------------------------------- training


def _texts(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"))


def _count_words(rows: DataFrame, shards: int, p: LmParams) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, held, total, cuts = resident("lm", "hasher", lambda: WordHasher(lower=True)), [], 0, _hash_cuts(shards)
        end = hasher.hashes([_END])
        done = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def merged():
            keys, counts = _sums(np.concatenate(held)) if held else done
            return _sums(np.concatenate((done[0], keys)), np.concatenate((done[1], counts))) if held else done

        def rows_of(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
            return _rows(keys, counts, np.searchsorted(cuts, keys, side="right") - 1)

        for batch in batches:
            for text in batch["_text"]:
                own = hasher.hashes(hasher.words(text))
                held += [own, end]
                total += len(own) + 1
                if total >= p.block_tokens:
                    done, held, total = merged(), [], 0
                    if len(done[0]) > p.block_tokens:
                        yield rows_of(*done)
                        done = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        done = merged()
        if len(done[0]):
            yield rows_of(*done)

    return rows.filter("_train").select("_text").mapInPandas(task("lm", run), _PACKED)


def _blocks(batches: Iterator[pd.DataFrame], p: LmParams, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined ids of several texts, and a mark at each text's first token."""
    held, total = [], 0
    for batch in batches:
        for raw in batch["ids"]:
            held.append(np.frombuffer(raw, kind))
            total += len(held[-1])
            if total >= p.block_tokens:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(sum(map(len, held)), bool)
    first[np.concatenate(([0], np.cumsum([len(x) for x in held])[:-1]))] = True
    return np.concatenate(held).astype(np.int64), first


def train(docs: DataFrame, training: Column, p: LmParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[LmModel, DataFrame]:
    """The model, and the documents' token ids for it (_id, _train, ids) in a staged table."""
    p = p or LmParams()
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rows = _texts(docs, training, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("_text")).alias("b"), F.sum(F.col("_train").cast("long")).alias("n")).first()
    shards = tuple(max(p.least_shards, int((size["b"] or 0) // b) + 1) for b in p.shard_bytes)
    folder, n_docs = new_folder(spark, "trie"), int(size["n"] or 0)

    def words(shard: int, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        _write(folder, f"words-{shard}", {"base": np.array([0]), **_sequence("h", keys), **_counts(counts)})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())], "most": [0]})

    totals = "shard int, n long, total long, most long"
    made = {r["shard"]: r for r in _built(_count_words(rows, shards[0], p), shards[0], words, totals).collect()}
    firsts = lambda found, level: tuple(int(x) for x in np.concatenate(([0], np.cumsum([found[s]["n"] if s in found else 0 for s in range(shards[level])]))))
    one = LmModel(folder, shards, p.discount, firsts(made, 0), (0,), sum(r["total"] for r in made.values()), n_docs)

    one.check()

    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = resident("lm", "hasher", lambda: WordHasher(lower=True))
        end = hasher.hashes([_END])
        for texts in batches:
            held = [np.concatenate((hasher.hashes(hasher.words(t)), end)) for t in texts]
            ids = one.ids(np.concatenate(held)).astype(one.id_type)
            cuts = np.cumsum([len(x) for x in held])[:-1]
            yield pd.Series([x.tobytes() for x in np.split(ids, cuts)], dtype=object)

    numbered = staged(rows.select("_id", "_train", column_udf("lm", "binary", number)("_text").alias("ids")), "ids")
    if not one.n_words:
        return one, numbered
    trained = numbered.filter("_train").select("ids")

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, first in _blocks(batches, p, one.id_type):
            u = np.concatenate(([one.start], ids[:-1]))
            u[first] = one.start
            keys, counts = _sums((u * one.span + ids).astype(np.uint64))
            yield _rows(keys, counts, one.shard_of((keys // np.uint64(one.span)).astype(np.int64)))

    def pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        low = -(-shard * one.span // shards[1])  # the least context of this shard
        high = min(-(-(shard + 1) * one.span // shards[1]), one.span)
        keep = counts >= p.min_count
        keys, counts = keys[keep], counts[keep]
        u, w = (keys // np.uint64(one.span)).astype(np.int64), (keys % np.uint64(one.span)).astype(np.int64)
        contexts = np.arange(low, high)
        size = one.counts(contexts)
        taken = counts - p.discount
        left = _left(np.bincount(u - low, taken, minlength=high - low), size)
        word, back = np.unique(w, return_inverse=True)
        logs = np.log10(taken / size[u - low] + 10 ** (left[u - low] + one.log_word(word)[back])) if len(u) else np.zeros(0)
        begins = np.concatenate(([0], np.cumsum(np.bincount(u - low, minlength=high - low))))
        _write(folder, f"pairs-{shard}", {"base": np.array([low]), **_sequence("keys", keys - np.uint64(low) * np.uint64(one.span)), **_sequence("pointers", begins), "q": _quantised(logs), **_counts(counts), "left": _quantised(left)})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())], "most": [int(np.diff(begins).max(initial=0))]})

    made = {r["shard"]: r for r in _built(trained.mapInPandas(task("lm", count_pairs), _PACKED), shards[1], pairs, totals).collect()}
    two = LmModel(folder, shards, p.discount, one.words, firsts(made, 1), one.n_tokens, n_docs, max([1, *(r["most"] for r in made.values())]))

    def count_triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, first in _blocks(batches, p, one.id_type):
            u = np.concatenate(([two.start], ids[:-1]))
            u[first] = two.start
            distinct, back = np.unique(u * two.span + ids, return_inverse=True)
            pu, pw = np.divmod(distinct, two.span)
            found = two.find_pairs(pu, pw)
            ranks = np.where(found >= 0, found - two.first_pair(pu), 0)[back]
            pair = found[back]
            node = np.concatenate(([-1], pair[:-1]))
            node[first] = -1
            both = (node >= 0) & (pair >= 0)
            keys, counts = _sums((node[both] * two.fanout + ranks[both]).astype(np.uint64))
            if len(keys):
                yield _rows(keys, counts, two.shard_of_pair((keys // np.uint64(two.fanout)).astype(np.int64)))

    def triples(shard: int, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        n_pairs = two.pairs[-1]
        low, high = -(-shard * n_pairs // shards[2]), min(-(-(shard + 1) * n_pairs // shards[2]), n_pairs)
        keep = counts >= p.min_count
        keys, counts = keys[keep], counts[keep]
        node, rank = (keys // np.uint64(two.fanout)).astype(np.int64), (keys % np.uint64(two.fanout)).astype(np.int64)
        size = two.pair_count(np.arange(low, high))
        taken = counts - p.discount
        left = _left(np.bincount(node - low, taken, minlength=high - low), size)
        nodes, back = np.unique(node, return_inverse=True)
        below = two.first_pair(two.second(nodes))[back] + rank
        logs = np.log10(taken / np.maximum(size[node - low], 1) + 10 ** (left[node - low] + two.log_pair(below))) if len(node) else np.zeros(0)
        _write(folder, f"triples-{shard}", {"base": np.array([low]), **_sequence("keys", keys - np.uint64(low) * np.uint64(two.fanout)), "q": _quantised(logs), "left": _quantised(left)})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())], "most": [0]})

    two.check()
    _built(trained.mapInPandas(task("lm", count_triples), _PACKED), shards[2], triples, totals)
    return two, numbered


def score(numbered: DataFrame, model: LmModel, p: LmParams | None = None, id_col: str = "doc_id") -> DataFrame:
    """Id, n_tokens, n_known, train_tokens, base_score, score of every document of a table of token ids."""
    p = p or LmParams()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def flush(held: list[np.ndarray]) -> pd.DataFrame:
            ids, first = _joined(held)
            log, base, known = model.score(ids, first)
            at = np.flatnonzero(first)
            sums = lambda x: np.add.reduceat(x, at)
            return pd.DataFrame({"n_tokens": [len(x) for x in held], "n_known": sums(known.astype(np.int64)), "base_score": sums(base), "score": sums(log)})

        held, total = [], 0
        for batch in batches:
            for raw in batch:
                held.append(np.frombuffer(raw, model.id_type))
                total += len(held[-1])
                if total >= p.block_tokens:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    made = column_udf("lm", "n_tokens long, n_known long, base_score double, score double", run)("ids")
    rows = numbered.select(F.col("_id").alias(id_col), made.alias("_m"))
    return rows.select(id_col, "_m.n_tokens", "_m.n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "_m.base_score", "_m.score")
