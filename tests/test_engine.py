import datetime
import json
import socket
import threading
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import load
from quern.functions import values as V
from quern.functions.types import parse_type, schema_of
from quern.functions.values import ValueTypeError, literal, typed
from quern.operators import mapping as M
from quern.operators.routing import store_for
from quern.plans import Call, Field, Filter, Literal, Passthrough, PlanError, Project, Query, Scan, Scope, parse
from quern.plans.mql import relaxed_json
from quern.sources.generators import interval_source, register_sources
from quern.sources.messages import mqtt_value, parse_messages
from quern.streaming import GraphSink, JdbcSink, KafkaSink, Ledger, Metrics, ParquetSink, Pipeline, TcpFeed, TopicFeed, from_wire, storable, to_wire
from quern.streaming.sinks import edges, nodes

CONFIG = """
[store.lake]
model = "relational"
[store.web]
model = "graph"

[def.harvest]
model = "relational"
entity = "crates"
filter.key = { kind = "crate" }
mapping.relational = [{ fruit = "TEXT" }, { kilos = "FLOAT" }, { row = "INT" }]
processing.sql = "SELECT fruit, kilos * 2 - row FROM $$source"

[def.notes]
model = "doc"
entity = "notes"
filter.topic = "diary"
mapping.document = { initial = { key = "body" }, auto = [{ list = ["mood", "score"] }] }
processing.mql = "db.$$source.aggregate([{$match: {mood: 'calm'}}, {$project: {score: 1, was: '$mood'}}])"

[def.roads]
model = "graph"
entity = "roads"
filter.topic = "map"
processing.cypher = "MATCH (t:$$source:Town) RETURN t.size, t.name"
mapping.graph.node = { id = { doc.key = "no" }, label = { doc.key = "is" }, properties = { doc.key = "of" } }
"""


def one(spark, op, *args):
    return spark.range(1).select(op(*args).col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "op, a, b, want",
    [
        (V.add, 9, -2, 7), (V.add, -1, 0.25, -0.75), (V.add, "k", False, "kfalse"), (V.add, "k", 12.0, "k12"), (V.add, "k", -0.125, "k-0.125"),
        (V.add, "k", 25000000.5, "k25000000.5"), (V.add, "k", 1e12, "k1000000000000"), (V.add, "k", None, "knull"), (V.add, "", "é", "é"),
        (V.minus, 1, 8, -7), (V.minus, 0.5, 2, -1.5), (V.multiply, -3, 0.5, -1.5), (V.multiply, "ab", 2, "abab"), (V.multiply, "ab", 0, ""),
        (V.divide, 7, 8, 0.875), (V.divide, 0.75, 3, 0.25), (V.divide, 2, 0, float("inf")), (V.divide, -2.5, 0, float("-inf")),
        (V.equal, 12, "012", True), (V.equal, "012", 12, False), (V.equal, 12, "twelve", False), (V.equal, None, None, True), (V.equal, None, "null", False), (V.equal, 7, 7.0, True),
        (V.gt, 1.5, 1, True), (V.gt, None, -4, False), (V.gt, -4, None, True), (V.gt, "b", "a", True), (V.index, "über", 0, "ü"), (V.index, "ab", -1, None), (V.index, "ab", 2, None),
    ],
)
def test_values(spark, op, a, b, want):
    assert one(spark, op, literal(a), literal(b)) == want


def test_dates_times_arrays(spark):
    df = spark.range(1).select(
        F.lit("2024-02-27").cast("date").alias("d"), F.array(F.lit(4.0), F.lit(2.5)).alias("a"), F.struct(F.lit(10).cast("long").alias("ms"), F.lit(999_999).alias("ns")).alias("t"),
        F.lit("2024-02-27 10:00:00").cast("timestamp").alias("at"), F.create_map(F.lit("x"), F.lit(1.0)).alias("m"),
    )
    out = df.select(
        V.add(typed(df, "d"), literal(3)).col.alias("d"), V.add(typed(df, "d"), typed(df, "d")).col.alias("dd"), V.add(typed(df, "a"), literal(1)).col.alias("a"),
        V.add(typed(df, "t"), literal(0.000001)).col.alias("t"), V.as_text(typed(df, "a")).col.alias("s"), V.as_text(typed(df, "m")).col.alias("ms"),
        V.length(typed(df, "a")).col.alias("n"), V.as_time(literal("2024-02-27T09:00:00Z")).col.alias("x"), V.as_date(literal("no date")).col.alias("y"), V.as_int(typed(df, "at")).col.alias("z"),
    ).first()
    assert out["d"] == datetime.date(2024, 3, 1) and out["a"] == [4.0, 2.5, 1.0] and tuple(out["t"]) == (11, 0) and out["s"] == "[4,2.5]" and out["ms"] == "[x:1]" and out["n"] == 2
    assert out["dd"] == datetime.date(1970, 1, 1) + 2 * (datetime.date(2024, 2, 27) - datetime.date(1970, 1, 1)) and out["y"] is None and out["z"] == 1709028000000
    for bad in (lambda: V.add(literal(False), literal(2)), lambda: V.as_array(literal("x")), lambda: V.as_dict(literal(1)), lambda: V.as_node(typed(df, "t")), lambda: V.as_edge(literal(1))):
        with pytest.raises(ValueTypeError):
            bad()
    v = spark.range(1).select(F.parse_json(F.lit('[1, "b"]')).alias("a"), F.parse_json(F.lit('{"k": 2}')).alias("m"))
    got = v.select(F.size(V.as_array(typed(v, "a")).col).alias("n"), F.map_keys(V.as_dict(typed(v, "m")).col).alias("k")).first()
    assert got["n"] == 2 and got["k"] == ["k"]


def test_accumulation_by_type(spark):
    rows = [(1, 0.5, True, "b", ["y"], datetime.date(1970, 1, 3), datetime.datetime(1970, 1, 1, 0, 0, 1), {"p": 1}), (2, 1.0, False, "a", ["x", "z"], datetime.date(1970, 1, 4), datetime.datetime(1970, 1, 1, 0, 0, 2), {"p": 3, "q": 2}), (None,) * 8]
    df = spark.createDataFrame(rows, "i long, f double, b boolean, t string, a array<string>, d date, s timestamp, m map<string,long>")
    got = df.agg(*[V.add_assign(typed(df, c)).col.alias(c) for c in df.columns]).first()
    assert (got["i"], got["f"], got["b"], got["t"], got["a"], got["d"], got["m"]) == (3, 1.5, False, "ab", ["x", "z", "y"], datetime.date(1970, 1, 6), {"p": 3, "q": 2})
    assert df.agg(F.unix_seconds(V.add_assign(typed(df, "s")).col)).first()[0] == 3


def test_a_large_group_of_dictionaries_accumulates_in_time(spark):
    df = spark.range(12_000).selectExpr("map('k' || id % 9, id) AS m")
    limit = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # sorting the group again for each of its entries takes minutes
    limit.start()
    try:
        got = df.agg(V.add_assign(typed(df, "m")).col.alias("m")).first()["m"]
    finally:
        limit.cancel()
    assert got == {f"k{k}": max(i for i in range(12_000) if i % 9 == k) for k in range(9)}


def test_largest_entries_accumulate_to_the_same(spark):
    m = "CASE WHEN id % 4 = 0 THEN map('k' || id % 7, if(id % 3 = 0, null, double(id % 11)), 'z', if(id % 5 = 0, double('NaN'), null)) WHEN g = 1 THEN null WHEN id % 4 = 1 THEN map() ELSE map('z', 1.5D) END"
    df = spark.range(0, 400, 1, 5).selectExpr("id", "if(id % 4 = 3, 1, if(id % 4 = 1, null, id % 3 + 2)) AS g").selectExpr("g", f"{m} AS m")
    total = lambda x: {r["g"]: str(r["m"]) for r in x.groupBy("g").agg(V.add_assign(typed(x, "m")).col.alias("m")).collect()}
    few = V.largest_entries(df, ["g"], "m")
    want = total(df)
    assert few.columns == ["g", "m"] and total(few) == want and want[1] == want[None] == "{}" and len(want) == 5
    assert few.count() == 2 + 3 * 8  # a row for each group and key, one for a group without keys


@pytest.mark.parametrize("value, want", [(4, True), (-4, False), (0.0, False), ("\ttrue", False), (" True ", True), ("1", True), ("on", False), (None, False), (False, False)])
def test_truthiness(spark, value, want):
    assert one(spark, V.as_bool, literal(value)) is want


def test_types():
    assert parse_type("INT").simpleString() == "bigint" and parse_type("varchar(9)").simpleString() == "varchar(9)"
    assert schema_of([{"when": "date"}, {"much": "f"}]).names == ["when", "much"]
    with pytest.raises(ValueError):
        parse_type("polygon")


def test_frontends(spark):
    plan = parse("sql", "SELECT w, h * 2 + w FROM $$source")
    assert plan.scope is Scope.TUPLE and plan.sql() == "SELECT w AS field0, h * 2.0 + w AS field1 FROM $$source"
    df = spark.createDataFrame([(5, 2), (6, 1)], "w long, h long")
    assert [tuple(r) for r in plan.apply(df).collect()] == [(5, 9.0), (6, 8.0)]
    assert df.transform(Query("sql", "SELECT w AS x FROM $$source WHERE h > 1 ORDER BY 1 LIMIT 1")).first()["x"] == 5
    assert df.transform(Query("sql", "SELECT true, null FROM $$source")).count() == 2
    assert relaxed_json("[{$project: {'p': 1, q: \"$r\",},}, // note\n]") == [{"$project": {"p": 1, "q": "$r"}}]
    for language, text in (("sql", "DELETE FROM t"), ("mql", "db.t.insert({})"), ("mql", "db.t.aggregate([{$out: 'u'}])"), ("cypher", "MATCH (p:s:L) RETURN q.x"), ("cypher", "MATCH (p:s:L) RETURN p.x WHERE"), ("gql", "")):
        with pytest.raises(PlanError):
            parse(language, text)


def test_reprinted_calls_keep_their_grouping(spark):
    f = {c: Field(c) for c in "abc"}
    trees = [
        (Call("*", (Call("+", (f["a"], f["b"])), f["c"])), "(a + b) * c"), (Call("-", (f["a"], Call("-", (f["b"], f["c"])))), "a - (b - c)"), (Call("-", (Call("-", (f["a"], f["b"])), f["c"])), "a - b - c"),
        (Call("/", (f["a"], Call("*", (f["b"], f["c"])))), "a / (b * c)"), (Call(">", (Call("+", (f["a"], f["b"])), Literal(2))), "a + b > 2"), (Call("+", (f["a"], Call("*", (f["b"], f["c"])))), "a + b * c"),
    ]
    df = spark.createDataFrame([(7, 5, 3)], "a long, b long, c long")
    for tree, text in trees:
        assert tree.sql() == text
        mine = Project((("x", tree),)).apply(df).first()["x"]
        assert float(mine) == float(df.selectExpr(f"{text} AS x").first()["x"])
    assert Passthrough("later", Filter(f["a"])).sql() == "SELECT * FROM $$source WHERE a"


@pytest.mark.parametrize(
    "predicate, pushed",
    [
        (Call("=", (Field("o_orderstatus"), Literal("F"))), "EqualTo(o_orderstatus,F)"),
        (Call(">", (Field("o_totalprice"), Literal(1000))), "GreaterThan(o_totalprice,1000.0)"),
        (Call("=", (Field("o_custkey"), Literal(7))), "EqualTo(o_custkey,7)"),
        (Field("o_totalprice"), "GreaterThan(o_totalprice,0.0)"),
    ],
)
def test_filters_reach_the_scan(spark, data_dir, predicate, pushed):
    df = Project((("o_orderkey", Field("o_orderkey")),), Filter(predicate, Scan())).apply(spark.read.parquet(f"{data_dir}/orders.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.replace(" ", "")


def test_filters_treat_null_as_before(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (3, "b")], "n long, t string")
    keep = lambda e: [r["n"] for r in Filter(e).apply(df).collect()]
    assert keep(Call("=", (Field("t"), Literal("a")))) == [1] and keep(Call(">", (Field("n"), Literal(1)))) == [3] and keep(Call("=", (Field("t"), Literal(None)))) == [None]
    assert keep(Call(">", (Field("n"), Literal(None)))) == [1, 3] and keep(Field("n")) == [1, 3]


def _records(spark):
    data = [
        (["farm"], '{"kind": "crate", "fruit": "fig", "kilos": 4.5, "row": 2}'), (None, '{"kind": "crate", "fruit": "plum", "kilos": "x", "row": 1}'), (["diary"], '{"body": {"mood": "calm", "score": 6}}'),
        (["diary"], '["calm", 8]'), (["diary"], '["cross", 1]'), (["map"], '{"no": 4, "is": "Town", "of": {"size": "9", "name": "Ulm"}}'), (["map"], '{"no": 5, "is": "Lake", "of": {"size": "9"}}'), (["other"], "3"),
    ]
    return spark.createDataFrame(data, "topics array<string>, raw string")


def _check(spark, sink):
    assert sorted((tuple(r) for r in sink.read(spark, "crates").select("field0", "field1").collect()), key=repr) == [("fig", 7.0), ("plum", None)]
    assert sorted(tuple(r) for r in sink.read(spark, "notes").select("score", "was").collect()) == [("6", "calm"), ("8", "calm")]
    assert [tuple(r) for r in sink.read(spark, "roads").drop("batch").collect()] == [("9", "Ulm")]
    assert sink.read(spark, "dead_letters").count() == 1 and sink.read(spark, "crates_native").count() == 2 and sink.read(spark, "notes_plain").count() == 3


def test_pipeline_batch_and_stream_agree(spark, tmp_path):
    catalog = load(CONFIG)
    assert catalog.stores == {"lake": "relational", "web": "graph"} and list(catalog.definitions) == ["harvest", "notes", "roads"]
    with pytest.raises(ValueError):
        catalog.add(catalog.definitions["notes"])
    sink = ParquetSink(str(tmp_path / "batch"))
    for _ in range(2):  # a replayed batch replaces itself
        Pipeline(catalog, sink).run_batch(_records(spark).select("topics", F.parse_json("raw").alias("value")), 7)
    _check(spark, sink)
    _records(spark).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("topics array<string>, raw string").json(str(tmp_path / "in")).select("topics", F.parse_json("raw").alias("value"))
    sink = ParquetSink(str(tmp_path / "stream"))
    query = Pipeline(catalog, sink).start(stream, str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(120)
    _check(spark, sink)


def test_definitions_go_to_the_cheapest_store(spark, tmp_path):
    stores = {"lake": "relational", "web": "graph"}
    assert store_for("graph", stores) == "web" and store_for("graph", stores, {"web": 3.0}) == "lake" and store_for("document", stores) == "lake"
    with pytest.raises(ValueError):
        store_for("graph", {})
    lake, web = ParquetSink(str(tmp_path / "lake")), ParquetSink(str(tmp_path / "web"))
    Pipeline(load(CONFIG), {"lake": lake, "web": GraphSink(web)}).run_batch(_records(spark).select("topics", F.parse_json("raw").alias("value")))
    assert lake.read(spark, "crates").count() == 2 and lake.read(spark, "dead_letters").count() == 1
    got = {r["id"]: (r["labels"], r["properties"].get("name")) for r in web.read(spark, "roads_native_nodes").collect()}
    assert got == {4: (["Town"], "Ulm"), 5: (["Lake"], None)} and not (tmp_path / "lake" / "roads").exists()


def test_a_failing_definition_fails_the_batch(spark, tmp_path):
    class Broken(ParquetSink):
        def write(self, df, table, batch):
            if table == "notes_native":
                raise OSError("full")
            super().write(df, table, batch)

    df = _records(spark).select("topics", F.parse_json("raw").alias("value"))
    with pytest.raises(OSError, match="full"):
        Pipeline(load(CONFIG), Broken(str(tmp_path))).run_batch(df, 1)
    Pipeline(load(CONFIG), ParquetSink(str(tmp_path)), parallel=1).run_batch(df, 1)
    _check(spark, ParquetSink(str(tmp_path)))


def test_relational_store_replaces_a_replayed_batch(spark):
    url = "jdbc:derby:memory:quern;create=true"
    sink, plain = JdbcSink(url, {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}), _records(spark).select("topics", F.parse_json("raw").alias("value"))
    for batch in (3, 4, 3):
        Pipeline(load(CONFIG), sink).run_batch(plain, batch)

    def read(table):
        return spark.read.format("jdbc").option("url", url).option("dbtable", table).option("driver", sink.options["driver"]).load()

    crates = read("crates")
    assert sorted((r["batch"], r["n"]) for r in crates.groupBy("batch").agg(F.count("*").alias("n")).collect()) == [(3, 2), (4, 2)]
    raw = read("crates_plain").filter("batch = 3").collect()
    assert len(raw) == 2 and all(json.loads(r["value"])["kind"] == "crate" for r in raw)
    assert json.loads(read("notes_plain").first()["topics"]) == ["diary"]


def test_ledger_passes_over_written_batches(spark, tmp_path):
    written = []

    class Store:
        def write(self, df, table, batch):
            if (table, batch) == ("b", 2) and ("b", 2) not in written:
                written.append(("b", 2))
                raise OSError("down")
            written.append((table, batch, df.count()))

    sink = Ledger(Store(), str(tmp_path / "notes"))
    sink.write(spark.range(3), "a", 2)
    with pytest.raises(OSError, match="down"):
        sink.write(spark.range(4), "b", 2)
    for table, n in (("a", 3), ("b", 4)):
        sink.write(spark.range(n), table, 2)
    sink.write(spark.range(5), "a", 3)
    assert written == [("a", 2, 3), ("b", 2), ("b", 2, 4), ("a", 3, 5)]


def test_storable_columns(spark):
    df = spark.sql("SELECT 1 AS n, parse_json('{\"a\": 1}') AS v, array(parse_json('2')) AS vs, named_struct('x', 1) AS s, map('k', array(1)) AS `odd.name`")
    flat, deep = storable(df, nested=False), storable(df, nested=True)
    assert [tuple(r) for r in flat.collect()] == [(1, '{"a":1}', "[2]", '{"x":1}', '{"k":[1]}')]
    assert deep.schema["s"].dataType == df.schema["s"].dataType and deep.schema["odd.name"].dataType == df.schema["odd.name"].dataType
    assert deep.schema["v"].dataType == deep.schema["vs"].dataType == T.StringType()


def test_graph_tables(spark, tmp_path):
    raw = ['{"id": 1, "label": "KNOWS", "source": 4, "target": 5, "properties": {"since": "2001"}}', '{"id": 2, "label": "KNOWS", "source": 4}', '"no edge"']
    df = spark.createDataFrame([(x,) for x in raw], "raw string").select(M.edge(F.parse_json("raw")).alias("value"))
    assert [tuple(r) for r in edges(df).collect()] == [(1, "KNOWS", 4, 5, {"since": "2001"})]
    sink = ParquetSink(str(tmp_path))
    GraphSink(sink).write(df, "met", 0)
    assert sink.read(spark, "met_edges").count() == 1
    odd = spark.createDataFrame([('{"id": "x", "label": 3}',), ("[]",)], "raw string").select(M.node(F.parse_json("raw")).alias("value"))
    assert [tuple(r) for r in nodes(odd).collect()] == [(0, ["3"], {})]


def test_feeds_send_all_processed_rows(spark, tmp_path):
    rows = [(["x"], f'{{"kind": "crate", "fruit": "f", "kilos": {i}, "row": 0}}') for i in range(1200)] + [(["farm"], '{"kind": "crate", "fruit": "g", "kilos": 1, "row": 0}'), (["diary", "x"], '["calm", 2]'), (["x"], "1"), (None, "2")]
    df = spark.createDataFrame(rows, "topics array<string>, raw string").select("topics", F.parse_json("raw").alias("value"))
    lines, server = [], socket.create_server(("127.0.0.1", 0))
    peers = []

    def listen():
        for _ in range(3):  # a definition each
            with server.accept()[0] as peer, peer.makefile() as f:
                peers.extend(f)

    thread = threading.Thread(target=listen)
    thread.start()
    Pipeline(load(CONFIG), ParquetSink(str(tmp_path)), [TopicFeed("x", lines.append), TcpFeed("x", *server.getsockname())]).run_batch(df)
    thread.join(30)
    for got in (list(map(json.loads, lines)), list(map(json.loads, peers))):
        assert sorted(r["field1"] for r in got if "field1" in r) == [2.0 * i for i in range(1200)]
        assert [r for r in got if "field1" not in r] == [{"score": "2", "was": "calm"}]


def test_files_rotate_by_rows(spark, tmp_path):
    ParquetSink(str(tmp_path), rows_per_file=40).write(spark.range(100).coalesce(1), "t", 3)
    assert len(list((tmp_path / "t" / "batch=3").glob("*.parquet"))) == 3


def test_wire_and_broker_forms(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123000)
    df = spark.createDataFrame([(["a", "b"], (3, {"k": "v"}), at)], "topics array<string>, value struct<id:long,props:map<string,string>>, ts timestamp")
    back = df.select(from_wire(to_wire(F.col("value"), F.col("topics"), F.col("ts")), df.schema["value"].dataType).alias("m")).first()["m"]
    assert back["topics"] == ["a", "b"] and back["value"]["id"] == 3 and back["value"]["props"] == {"k": "v"} and back["timestamp"] == at
    assert spark.range(1).select(from_wire(F.lit("junk"), T.LongType()).alias("m")).first()["m"] is None
    out = KafkaSink("none:1", "q-").frame(df.select("topics"), "t", 4).first()
    assert out["topic"] == "q-t" and json.loads(out["value"]) == {"topics": ["a", "b"]} and out["key"].startswith("4-")
    raw = spark.createDataFrame([(b'{"topics": ["u"], "value": "1"}',), (b"{",), (b'{"value": "2"}',), (None,)], "value binary")
    assert [tuple(r) for r in parse_messages(raw).collect()] == [(["u"], "1")]
    got = spark.range(1).select(mqtt_value(F.lit(b"21.5"), F.lit("room/1")).alias("v")).first()["v"]
    assert got["$"] == "21.5" and got["$topic"] == "room/1"


def test_ramping_source_slows_down():
    from quern.sources.generators import _RampingReader

    reader = _RampingReader({"intervalMs": "20", "deltaMs": "5"})
    start = {"n": 0, "due": time.time() - 1, "gap": 0.02}
    rows, end = reader.read(start)
    rows = list(rows)
    assert 15 <= len(rows) <= 20 and end["gap"] > 0.09 and len(list(reader.readBetweenOffsets(start, end))) == end["n"] == len(rows)


def test_sources_and_metrics_through_streams(spark, tmp_path):
    register_sources(spark)
    sent = []
    metrics = Metrics(sent.append, every=0.0)
    spark.streams.addListener(metrics)
    try:
        ramp = spark.readStream.format("ramping").option("topic", "t").option("value", "5").option("intervalMs", "1").option("deltaMs", "0").load()
        ticks = interval_source(spark, "s", '{"v": 1}', 50).select(F.get("topics", F.lit(0)).alias("topic"), F.try_variant_get("value", "$.v", "long").alias("v"))
        for name, df in (("ramp", ramp), ("ticks", ticks)):
            query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
            end = time.time() + 60
            while spark.table(name).count() < 5 and time.time() < end:
                time.sleep(0.3)
            assert str(query.id) in metrics.alive or not metrics.alive
            query.stop()
        got = spark.table("ramp").orderBy("n").collect()
        assert [r["n"] for r in got] == list(range(len(got))) and {(r["topic"], r["value"]) for r in got} == {("t", "5")}
        assert {tuple(r) for r in spark.table("ticks").collect()} == {("s", 1)}
        end = time.time() + 20
        while not sent and time.time() < end:
            time.sleep(0.2)
        assert {"query", "batch", "rows", "per_second"} <= set(json.loads(sent[-1])) and sum(metrics.rows.values()) > 0
    finally:
        spark.streams.removeListener(metrics)


def test_reports_by_query_and_depth():
    def progress(query, behind=None, rows=10):
        source = SimpleNamespace(metrics=None if behind is None else {"maxOffsetsBehindLatest": str(behind)})
        return SimpleNamespace(progress=SimpleNamespace(id=query, batchId=1, numInputRows=rows, processedRowsPerSecond=2.5, sources=[source]))

    sent = []
    metrics = Metrics(lambda line: sent.append(json.loads(line)), every=60.0, deep=100)
    for query, behind in (("a", 7), ("a", 100), ("b", None), ("a", 101), ("b", None)):
        metrics.onQueryProgress(progress(query, behind))
    assert [(r["query"], r["rows"], r["behind"], r["deep"]) for r in sent] == [("a", 10, 7, False), ("b", 10, 0, False), ("a", 30, 101, True)]
    assert metrics.silent(5.0) == [] and metrics.silent(5.0, time.time() + 6) == ["a", "b"]
    metrics.onQueryTerminated(SimpleNamespace(id="a"))
    assert metrics.silent(5.0, time.time() + 6) == ["b"] and metrics.rows["a"] == 30
