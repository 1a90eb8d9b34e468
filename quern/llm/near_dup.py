"""Near-duplicate classes by weighted MinHash, banding, and a check of the multiset overlap.

Texts are multisets of shingles of ``shingle`` words (ASCII white space parts them, A-Z lower-cased); a text of fewer words,
but not none, is one shingle. Two texts are linked when the weighted Jaccard similarity of their multisets is at least
``threshold``; classes are the components of the links, named by their smallest id.

1. Texts with equal multisets collapse into one numbered node first, so thousands of copies are one row.
2. Nodes get BagMinHash signatures. Nodes that agree in a whole band are candidates; their multisets are written once, from
   one shuffle of the texts to their nodes, at every size of the input alike.
3. In every bucket each node is checked against the bucket's most central node, that which meets most nodes in all its
   buckets: the text that the others drifted from, as a rule. A pair is checked on its signatures (a pair of similarity 0.8
   falls under the bound by chance once in a million), then on its multisets. The components of the links are formed.
4. Nodes of buckets that still hold several components are open. Open nodes of different components are checked if their
   prefixes meet: with shingles in one order for all, rare ones first, two multisets that overlap enough share a shingle
   among the first of each, those before the rest weighs less than the overlap asked for; and what is left of both from the
   first such shingle on must suffice. So every link between candidates of different components is found in this one pass.

The order comes from count-min sketches, which never count too low: a shingle that no other open node holds is no key. So a
hot bucket of copies that drifted apart costs about its size, not its square, and no link is lost. Nothing is collected:
components spread by least labels with pointer jumps, in tables written to the shared folder.

Defined results: a text without words is in a class of its own; rows are judged by their texts, so rows that share an id
are in one class if their texts are; a null id gets the class of its copies, and the null class if no row of its class has
an id; ids may be of any type that Spark can order; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bagminhash import signature, similarity
from quern.llm.common import column_udf, compact, prepare, resident, staged, task
from quern.llm.sketch import BLOCKS, Counter, merged_bits, reached
from quern.llm.textfeatures import mix
from quern.llm.wordhash import WordHasher


#: Shingles are ordered by how many of these counts they reach among the open nodes.
_STEPS = (2, 8, 64)


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    #: Signatures that agree in a smaller share of places are not checked further.
    floor: float = 0.6
    #: Rounds in which a bucket's nodes are checked against one of them, before prefixes decide on the rest.
    hubs: int = 1
    #: Cells of the sketch that orders shingles, as a power of two, at most; it chooses an order, never a result.
    most_bits: int = 26
    #: Up to so many keys of rows (40 MB) are sent to drop rows by; beyond, rows are shuffled to the keys.
    sent: int = 1_000_000

    @property
    def places(self) -> int:
        return self.bands * self.rows


class _Shingler:
    def __init__(self, p: NearDupParams):
        self.p, self.hasher = p, resident("near_dup", "hasher", lambda: WordHasher(lower=True))

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes, and their counts."""
        h = self.hasher.hashes(self.hasher.words(text))
        if not len(h):
            return h, np.zeros(0, np.int64)
        shingles = self.hasher.windows(h, self.p.shingle) if len(h) >= self.p.shingle else self.hasher.spans(h, np.zeros(1, np.int64), np.full(1, len(h)))
        return np.unique(shingles, return_counts=True)


def _print(h: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """128 bits that equal multisets share."""
    lanes = [mix(mix(h ^ s) * n.astype(np.uint64)).sum(dtype=np.uint64) for s in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))]
    return tuple(int(np.int64(x.view(np.int64))) for x in lanes)


def _row_key(id_col: str, text_col: str):
    """16 bytes for a row's id and text: rows that repeat both have one key."""
    own = F.col(id_col).cast("string")
    return F.unhex(F.md5(F.concat(F.when(own.isNull(), "n").otherwise(F.concat(F.lit("i"), F.octet_length(own).cast("string"), F.lit(":"), own)), F.coalesce(F.col(text_col), F.lit("")))))


def signed(docs: DataFrame, p: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """_id, _rid, _a, _b (the multiset's print; null without words), _sig (little-endian 32-bit places) of every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = _Shingler(p)
        last: dict[tuple[int, int], bytes] = {}
        for batch in batches:
            out = []
            for text in batch:
                h, n = shingler.bag(text)
                if not len(h):
                    out.append((0, 0, None))
                    continue
                own = _print(h, n)
                if own not in last:
                    if len(last) > 2000:
                        last.clear()
                    last[own] = signature(h, n, p.places).astype("<u4").tobytes()
                out.append((*own, last[own]))
            yield pd.DataFrame(out, columns=["a", "b", "sig"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), _row_key(id_col, text_col).alias("_rid"), column_udf("near_dup", "a long, b long, sig binary", run)(text).alias("_s"))
    there = F.col("_s.sig").isNotNull()
    return rows.select("_id", "_rid", F.when(there, F.col("_s.a")).alias("_a"), F.when(there, F.col("_s.b")).alias("_b"), F.col("_s.sig").alias("_sig"))


def bags(docs: DataFrame, p: NearDupParams, id_col: str, text_col: str, named: DataFrame) -> DataFrame:
    """node, h, n: the multisets of the texts whose row keys are named (_rid, node), once each.

    Texts are shuffled to the names, at every size of the input, so that repeated rows of a key meet in one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = _Shingler(p), set()
        for batch in batches:
            new = [not (x in seen or seen.add(x)) for x in batch["node"]]
            batch = batch[new]
            found = [shingler.bag(t) for t in batch["_text"]]
            yield pd.DataFrame({"node": batch["node"], "h": [h.tobytes() for h, _ in found], "n": [n.astype("<i4").tobytes() for _, n in found]})

    texts = docs.select(_row_key(id_col, text_col).alias("_rid"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(named.select("_rid", "node").hint("shuffle_hash"), "_rid").select("node", "_text")
    return staged(found.mapInPandas(task("near_dup", run), "node long, h binary, n binary"), "bags")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of each component of the links (columns a, b), for all nodes that have a link.

    Every node takes the least label among itself and its neighbours, then its label's label, until nothing changes.
    """
    # the tables here hold a row or two a link, and are cut by that, not by the session's partitions
    rows = 2 * links.count()
    both = staged(compact(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), rows), "links")
    labels = staged(compact(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), rows), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), "comp")
        low = staged(compact(low, rows), "labels")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = staged(compact(low.join(up, "low").select("node", F.least("low", "up").alias("comp"), F.col("comp").alias("was")), rows), "labels")
        labels = new.select("node", "comp")
        if new.filter("comp <> was").isEmpty():
            return labels


def merged(comps: DataFrame | None, found: DataFrame) -> DataFrame:
    """node, comp after more links: only the components that the new links join are formed anew."""
    if comps is None:
        return components(found)
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    own = comps.unionByName(ends.join(comps, "node", "left_anti").withColumn("comp", F.col("node")))
    own = staged(compact(own, own.count()), "labels")
    over = found
    for end in ("a", "b"):
        over = over.join(own.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end)
    over = staged(compact(over.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), found.count()), "links")
    joined = components(over).select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    return staged(own.join(joined, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp")), "labels")


def _agreeing(p: NearDupParams):
    """Keeps pairs whose signatures agree in enough places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(-1, p.places) for c in ("sig_a", "sig_b"))
            yield batch.loc[(a == b).mean(axis=1) >= p.floor, ["a", "b"]]

    return run


def _linked(p: NearDupParams):
    """Keeps pairs whose multisets overlap enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                similarity(np.frombuffer(ha, np.uint64), np.frombuffer(na, "<i4"), np.frombuffer(hb, np.uint64), np.frombuffer(nb, "<i4")) >= p.threshold
                for ha, na, hb, nb in zip(batch["ha"], batch["na"], batch["hb"], batch["nb"], strict=True)
            ]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def prefix_keys(own: DataFrame, p: NearDupParams) -> DataFrame:
    """node, size, key, rest: the shared shingles of each node's prefix, and the weight from each on, itself included."""
    spark = own.sparkSession
    total = own.agg(F.sum(F.octet_length("h") / 8).alias("n")).first()["n"] or 0
    bits = int(np.clip(int(2 * total).bit_length(), 16, p.most_bits))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(bits)
        for batch in batches:
            for h in batch["h"]:
                yield from counter.add(np.frombuffer(h, np.uint64))
        yield from counter.blocks()

    partials = staged(own.select("h").mapInPandas(task("near_dup", count), BLOCKS), "counts")
    steps = spark.sparkContext.broadcast(merged_bits(partials, bits, *_STEPS))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, h, n in zip(batch["node"], batch["h"], batch["n"], strict=True):
                h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, "<i4").astype(np.int64)
                level = sum(reached(step, h, bits).astype(np.int64) for step in steps.value)
                order = np.lexsort((h, level))
                h, n, level, size = h[order], n[order], level[order], int(n.sum())
                rest = size - np.cumsum(n) + n
                use = (rest >= p.threshold * size - 1e-6) & (level > 0)
                out.append(pd.DataFrame({"node": node, "size": size, "key": h[use].view(np.int64), "rest": rest[use]}))
            if out:
                yield pd.concat(out)

    return staged(own.mapInPandas(task("near_dup", keys), "node long, size long, key long, rest long"), "keys")


def crossing(keys: DataFrame, p: NearDupParams) -> DataFrame:
    """a, b: nodes of different components whose prefixes meet, and that may overlap enough by what is left of both."""
    mixed = keys.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("key", "_lo")
    at = staged(keys.join(mixed, "key"), "mixed")
    x = at.filter("comp <> _lo").select("key", *[F.col(c).alias(c + "_x") for c in ("node", "comp", "size", "rest")])
    enough = F.least("rest", "rest_x") * (1 + p.threshold) >= p.threshold * (F.col("size") + F.col("size_x")) - 1e-6
    pairs = x.join(at, (x["key"] == at["key"]) & (F.col("comp") != F.col("comp_x")) & enough)
    return pairs.select(F.least("node_x", "node").alias("a"), F.greatest("node_x", "node").alias("b")).distinct()


def _classified(docs: DataFrame, p: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """_id, _rid and _rep of every row: of its class the first (id is null, id, row key)."""
    prepare(docs.sparkSession)
    rows = staged(signed(docs, p, id_col, text_col), "signatures")
    rep = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rid").alias("rid"))
    groups = rows.filter(F.col("_a").isNotNull()).groupBy("_a", "_b").agg(F.min(rep).alias("_rep"), F.first("_sig").alias("sig"))
    # a node is a distinct text; its number is written once, so it is the same wherever it is read
    nodes = staged(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    width = 4 * p.rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(p.bands)])
    members = nodes.select("node", F.explode(bands).alias("bucket"))
    # written first, so that their sizes are known where they are joined: few buckets are shared, and few nodes lie in one
    ends = staged(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "ends")
    members = staged(members.join(ends, "bucket"), "members")
    # a text that many drifted from meets more nodes than its copies meet each other
    central = staged(members.groupBy("node").agg(F.sum("size").alias("rank")), "central")
    members = staged(members.select("bucket", "node").join(central, "node"), "members")
    sharing = staged(members.select("node").distinct(), "sharing")
    shared = staged(nodes.join(sharing, "node", "left_semi").select("node", "sig", F.col("_rep.rid").alias("_rid")), "shared")
    sigs = shared.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    # the multisets of all that may have a link, from one pass over the texts
    held = bags(docs, p, id_col, text_col, shared)

    def verified(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sigs, "a").join(sigs.withColumnRenamed("a", "b").withColumnRenamed("sig_a", "sig_b"), "b")
        near = staged(near.select("a", "b", "sig_a", "sig_b").mapInPandas(task("near_dup", _agreeing(p)), "a long, b long"), "near")
        joined = near.join(held.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na")), "a").join(held.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb")), "b")
        return staged(joined.select("a", "b", "ha", "na", "hb", "nb").mapInPandas(task("near_dup", _linked(p)), "a long, b long").distinct(), "found")

    def labelled(at: DataFrame, comps: DataFrame | None, col: str) -> DataFrame:
        """at with the component of the nodes of a column."""
        if comps is None:
            return at.withColumn(f"{col}_comp", F.col(col))
        named = comps.select(F.col("node").alias(col), F.col("comp").alias("_comp"))
        return at.join(named, col, "left").withColumn(f"{col}_comp", F.coalesce("_comp", col)).drop("_comp")

    comps: DataFrame | None = None

    def link(pairs: DataFrame) -> None:
        nonlocal comps
        found = verified(staged(pairs, "pairs"))
        if not found.isEmpty():
            comps = merged(comps, found)

    at = members
    for _ in range(p.hubs):
        # among the nodes that no hub has joined to its own component yet
        at = staged(labelled(at.select("bucket", "node", "rank"), comps, "node"), "open")
        hubs = at.groupBy("bucket").agg(F.max(F.struct("rank", "node", "node_comp")).alias("_hub"), F.min("node_comp").alias("_lo"), F.max("node_comp").alias("_hi")).filter("_lo < _hi")
        hubs = staged(hubs.select("bucket", F.col("_hub.node").alias("hub"), F.col("_hub.node_comp").alias("hub_comp")), "hubs")
        if hubs.isEmpty():
            break
        at = staged(at.join(hubs, "bucket").filter("node_comp <> hub_comp"), "tried")
        link(at.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
        if comps is not None:
            # a hub's bucket stays open for the nodes that are still apart from it
            of_hub = comps.select(F.col("node").alias("hub"), F.col("comp").alias("_own"))
            at = labelled(at.drop("node_comp", "hub_comp"), comps, "node").join(of_hub, "hub", "left").filter(F.col("node_comp") != F.coalesce("_own", "hub"))
    at = staged(labelled(members.select("bucket", "node"), comps, "node"), "open")
    mixed = at.groupBy("bucket").agg(F.min("node_comp").alias("_lo"), F.max("node_comp").alias("_hi")).filter("_lo < _hi").select("bucket")
    left = staged(at.join(mixed, "bucket", "left_semi").select("node").distinct(), "left")
    if not left.isEmpty():
        keys = labelled(prefix_keys(staged(held.join(left, "node", "left_semi"), "open-bags"), p), comps, "node").withColumnRenamed("node_comp", "comp")
        link(crossing(keys, p))

    named = nodes.select("node", "_a", "_b", "_rep")
    if comps is not None:
        own = named.select("node", "_rep").join(comps, "node")
        least = staged(own.groupBy("comp").agg(F.min("_rep").alias("_least")), "least")
        of_node = staged(comps.join(least, "comp").select("node", "_least"), "classes")
        named = named.join(of_node, "node", "left").select("_a", "_b", F.coalesce("_least", "_rep").alias("_rep"))
    out = rows.select("_id", "_rid", "_a", "_b").join(named.select("_a", "_b", "_rep"), ["_a", "_b"], "left")
    return out.select("_id", "_rid", F.when(F.col("_a").isNull(), rep).otherwise(F.col("_rep")).alias("_rep"))


def classes(docs: DataFrame, p: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, and class_id, the least id of its class (null where no row of the class has one)."""
    return _classified(docs, p or NearDupParams(), id_col, text_col).select(F.col("_id").alias(id_col), F.col("_rep.id").alias("class_id"))


def keep_one(docs: DataFrame, p: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: of its least id, or, where no row of the class has an id, of its least row key."""
    p = p or NearDupParams()
    found = staged(_classified(docs, p, id_col, text_col).select("_rid", F.col("_rep.rid").alias("_kept")), "judged")
    gone = staged(found.filter(F.col("_rid") != F.col("_kept")).select("_rid").distinct(), "gone")
    again = staged(found.filter(F.col("_rid") == F.col("_kept")).groupBy("_rid").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("_rid"), "again")

    def sent(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= p.sent else keys

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = docs.select(row, _row_key(id_col, text_col).alias("_rid")).join(sent(gone), "_rid", "left_anti")
    if not again.isEmpty():
        few = sent(again)
        kept = kept.join(few, "_rid", "left_anti").unionByName(kept.join(few, "_rid", "left_semi").dropDuplicates(["_rid"]))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
