"""run() and each stage against plain forms, with odd rows, extra columns and an empty table."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as c
from quern.llm import toxicity
from quern.llm.queries import tokenizer_path
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, spans double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(5), tmp_path_factory.mktemp("tables")
    vocab = [f"{a}{b}{k}" for a in "bdgklm" for b in "aeiou" for k in "nrst"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base, item = text(60), text(140), text(14)
    texts = [text(rng.randrange(8, 90)) for _ in range(60)]
    texts += [f"{text(12)} {passage} {text(9)}" for _ in range(5)] + [base, base, base.replace(" ", " odd ", 1), f"{text(20)} {item.upper()}, {text(6)}"]
    texts += [f"{t} you vile stupid muckraker" for t in (text(20) for _ in range(24))]
    texts += [None, "", " \n", "short"]
    rows = [(i, t, "en", "s", len(t or ""), "x", 0.5) for i, t in enumerate(texts)] + [(None, base, None, None, None, None, None), (None, "no id at all", "en", "s", 12, "y", 1.5), (5, texts[5], "en", "s", 1, "x", 0.5)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts) if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "zzz"), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def key(r):
    return repr(tuple(r))


def test_stages_and_run_against_plain_forms(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = docs.columns, dict(c.STAGES)
    here = sorted(docs.collect(), key=key)

    def step(name):
        nonlocal docs
        docs = c.staged(stages[name](spark, docs, folder), name)
        assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
        return sorted(docs.collect(), key=key)

    # toxicity: the same model, row by row
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = step("toxicity")
    assert got == [r for r in here if model.score(r["text"]) < 0.7]
    assert not any("vile" in (r["text"] or "") for r in got) and len(got) > 60
    # near duplicates: one row of each class, of its least id
    here, got = got, step("near_dedup")
    order = sorted(here, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    classes = brute.near_classes([r["text"] for r in order])
    want, seen = [], set()
    for i, r in enumerate(order):
        own = (r["doc_id"], r["text"])
        if classes[i] == i and own not in seen:
            want.append(own)
            seen.add(own)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    # passages
    here, got = got, step("substring_dedup")
    kept = dict(zip([(r["doc_id"], r["text"]) for r in here], brute.substring_kept([(r["doc_id"], r["text"]) for r in here]), strict=True))
    want = []
    for r in here:
        k = kept[r["doc_id"], r["text"]]
        want.append((r["doc_id"], r["text"] if len(k) == len(brute.words(r["text"])) else " ".join(k)))
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr) and sorted(r["text"] or "" for r in here) != sorted(r["text"] or "" for r in got)
    # benchmark
    here, got = got, step("decontamination")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for old, new in zip(here, sorted(got, key=lambda r: [key(x) for x in here if x["doc_id"] == r["doc_id"] and x["source"] == r["source"]][0]), strict=True):
        hit = brute.hit_words(old["text"], items)
        left = [w for i, w in enumerate(brute.item_words(old["text"])) if i not in hit]
        assert brute.item_words(new["text"]) == left and (hit or old["text"] == new["text"])
        assert {k: v for k, v in new.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in old.asDict().items() if k not in ("text", "n_chars")}
    # packing, and run() as the same five stages
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = []
    for r in got:
        raw = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want += [(r["doc_id"], k, len(raw[s : s + 8192]) // 4, zlib.crc32(raw[s : s + 8192])) for k, s in enumerate(range(0, len(raw), 8192))]
    for out in (stages["packing"](spark, docs, folder), c.run(spark, folder)):
        packed = out.collect()
        assert sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed), key=repr) == sorted(want, key=repr)
        held = collections.defaultdict(list)
        for r in packed:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in held.values():
            assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert names == docs.columns


def test_an_empty_table_runs_through(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
