"""Ids come back as they went in: beyond 2^53, negative, beside nulls, and as text where an operator takes them."""

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, language_id, lm_scoring, near_dup, packing, quality_pu, substring_dedup, toxicity, warc
from quern.llm.queries import tokenizer_path

BIG = 1 << 60
IDS = [BIG + 1, BIG + 3, BIG + 5, -BIG - 7, None, (1 << 63) - 1]
TEXT = " ".join(f"w{i}" for i in range(80))


def frame(spark, ids=IDS, kind="long"):
    texts = [TEXT, TEXT, "another text of words", "x", TEXT, ""]
    return spark.createDataFrame(list(zip(ids, texts, ["en"] * 6, strict=True)), f"doc_id {kind}, text string, lang string").coalesce(1)


def operators(spark, docs):
    labels = spark.createDataFrame([(i, n % 2, n % 2) for n, i in enumerate(IDS)], "doc_id long, toxic int, quality int").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    bench = spark.createDataFrame([(BIG + 9, "w1 w2 w3"), (None, "another text")], "item_id long, text string")
    model, numbered = lm_scoring.train(docs, F.lit(True))
    yield "op1", quality_pu.score(docs, quality_pu.train(docs, labels))
    yield "op2", toxicity.score(docs, toxicity.train(docs, labels))
    yield "op3", decontaminate.digest(decontaminate.find(docs, bench))
    yield "op5", lm_scoring.score(numbered, model)
    yield "op6", packing.pack(docs, packing.PackingParams(tokenizer_path())).filter("piece = 0")
    yield "op8", language_id.predict(docs, language_id.train(docs))
    yield "op9", near_dup.classes(docs)


def test_large_ids_beside_nulls(spark):
    docs = frame(spark)
    for name, out in [*operators(spark, docs), ("op4", substring_dedup.dedup(docs))]:
        assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted(IDS, key=repr), name
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
    assert {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}[BIG + 3] == BIG + 1
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).collect()}
    assert removed[BIG + 1] == 0 and removed[BIG + 3] == 80 and removed[None] == 80


def test_text_ids(spark):
    ids = ["b", "a", "c", "", None, "9"]
    docs = frame(spark, ids, "string")
    for name, out in operators(spark, docs):
        assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted(ids, key=repr), name
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert classes["a"] == classes["b"] == classes[None] == "a"
    with pytest.raises(TypeError):
        substring_dedup.dedup(docs)
    with pytest.raises(TypeError):
        warc.round_trip(docs.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))


def test_large_page_ids(spark):
    html = "<p>" * 500
    rows = [(BIG + 1, html), (BIG + 3, html), (-BIG - 1, "s"), (None, html), (None, "z")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").coalesce(1)
    for sent in (500_000, 0):
        got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, warc.WarcParams(sent=sent)).collect()), key=repr)
        assert got == sorted([(BIG + 1, "revisit", BIG + 3), (BIG + 3, "response", None), (-BIG - 1, "response", None), (None, "revisit", BIG + 3), (None, "response", None)], key=repr)


def test_rows_without_an_id_stay_once_a_class(spark):
    near = TEXT.replace("w40 ", "other ")
    rows = [(None, TEXT), (None, TEXT), (None, near), (4, "short one"), (None, "short one"), (4, "short one"), (4, "unlike it"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sent in (1_000_000, 0):
        kept = sorted((tuple(r) for r in near_dup.keep_one(docs, near_dup.NearDupParams(sent=sent)).collect()), key=repr)
        alone = [r for r in kept if r[1] not in (TEXT, near)]
        assert len(kept) - len(alone) == 1
        # texts without words are classes of their own, and rows alike in id and text are one
        assert [r for r in alone if r[1]] == [(4, "short one"), (4, "unlike it")] and len([r for r in alone if not r[1]]) == 1
