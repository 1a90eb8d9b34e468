from quern.llm import decontaminate


def test_items_without_id_are_hit_but_not_named(spark):
    word = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(0, " ".join(word)), (1, "short one"), (2, "clean")], "doc_id long, text string")
    items = [(None, " ".join(word[5:25])), (None, "Short"), (None, None), (7, " ".join(word[20:32])), (7, " ".join(word[5:25]))]
    for named, want in ((items, {0: (27, ["7"]), 1: (1, []), 2: (0, [])}), (items[:3], {0: (20, []), 1: (1, []), 2: (0, [])})):
        bench = spark.createDataFrame(named, "item_id long, text string")
        for p in (decontaminate.DecontaminationParams(), decontaminate.DecontaminationParams(block_phrases=20)):
            found = {r["doc_id"]: (sum(r["spans"][1::2]) - sum(r["spans"][::2]), list(r["items"])) for r in decontaminate.find(docs, bench, p).collect()}
            assert found == want
    out = {r["doc_id"]: r["_new"] for r in decontaminate.retext(docs, bench).collect()}
    assert out[0].split() == word[:5] + word[25:] and out[1].strip() == "one" and out[2] == "clean"
