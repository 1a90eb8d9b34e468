"""Registered queries over the test tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import values as V
from quern.functions.values import typed
from quern.operators import mapping as M
from quern.operators.routing import Definition, Entity, KeyEquals, TakeAll, Topic, route
from quern.plans import Call, Collect, Field, Filter, Literal, Passthrough, Project, Query, Scan, Unwind, parse
from quern.session import table
from quern.sources.cdc import apply_changes, parse_changes, parse_document_changes
from quern.sources.messages import mqtt_value, parse_messages
from quern.streaming.sinks import from_wire, to_wire
from quern.streaming.metrics import delay, load_class, open_ids, stage_counts, throughput

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _call(df: DataFrame, op, *cols) -> "F.Column":
    return op(*[c if isinstance(c, V.TypedColumn) else typed(df, c) for c in cols]).col


# ---------------------------------------------------------------- SQL frontend


@query("SELECT l_extendedprice + 7.5::DOUBLE AS field0 FROM lineitem")
def sql_project_add(spark: SparkSession, d: str) -> DataFrame:
    bids = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"))
    return bids.transform(Query("sql", "SELECT price + 7.5 FROM $$source"))


@query("SELECT l_extendedprice - l_discount AS field0, l_orderkey - 1.0::DOUBLE AS field1 FROM lineitem")
def sql_project_minus(spark, d):
    return table(spark, d, "lineitem").transform(Query("sql", "SELECT l_extendedprice - l_discount, l_orderkey - 1 FROM $$source"))


@query("SELECT p_size * 2.0::DOUBLE AS field0, p_retailprice * 0.5::DOUBLE AS field1, p_partkey * p_size AS field2 FROM part")
def sql_project_multiply(spark, d):
    return table(spark, d, "part").transform(Query("sql", "SELECT p_size * 2, p_retailprice * 0.5, p_partkey * p_size FROM $$source"))


@query("SELECT l_orderkey AS field0, l_extendedprice * 1.1::DOUBLE AS field1, l_suppkey AS field2, l_shipdate AS field3 FROM lineitem")
def nexmark_q1(spark, d):
    bids = table(spark, d, "lineitem").selectExpr("l_orderkey AS auction", "l_extendedprice AS price", "l_suppkey AS bidder", "l_shipdate AS dateTime")
    return bids.transform(Query("sql", "SELECT auction, price * 1.1, bidder, dateTime FROM $$source"))


@query("SELECT l_quantity * l_quantity AS field0 FROM lineitem")
def sql_square(spark, d):
    return table(spark, d, "lineitem").transform(Query("sql", "SELECT l_quantity * l_quantity FROM $$source"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE user_id > 10 GROUP BY event_type HAVING count(*) > 1")
def sql_full_clauses(spark, d):
    return table(spark, d, "events").transform(Query("sql", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM $$source WHERE user_id > 10 GROUP BY event_type HAVING count(*) > 1"))


# ---------------------------------------------------------------- values


@query("SELECT p_partkey, p_size::DOUBLE / p_partkey AS share, CASE WHEN p_size % 2 = 0 THEN 'Infinity'::DOUBLE ELSE p_size::DOUBLE / 1 END AS guarded FROM part")
def divide_float(spark, d):
    df = table(spark, d, "part")
    return df.select("p_partkey", _call(df, V.divide, "p_size", "p_partkey").alias("share"), _call(df, V.divide, "p_size", F.col("p_size") % 2).alias("guarded"))


@query("SELECT n_nationkey, n_name || n_regionkey::VARCHAR AS joined, n_name || 'true' AS flagged FROM nation")
def text_concat(spark, d):
    df = table(spark, d, "nation")
    return df.select("n_nationkey", _call(df, V.add, "n_name", "n_regionkey").alias("joined"), _call(df, V.add, "n_name", V.literal(True)).alias("flagged"))


@query("SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END AS half FROM part")
def text_add_float(spark, d):
    df = table(spark, d, "part").withColumn("half", F.col("p_size") / 2)
    return df.select("p_partkey", _call(df, V.add, "p_brand", "half").alias("half"))


@query("SELECT n_nationkey, repeat(n_name, n_regionkey) AS repeated FROM nation")
def text_repeat(spark, d):
    df = table(spark, d, "nation")
    return df.select("n_nationkey", _call(df, V.multiply, "n_name", "n_regionkey").alias("repeated"))


@query("SELECT o_orderkey, o_orderdate::DATE + 5 AS due FROM orders")
def date_add_days(spark, d):
    df = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return df.select("o_orderkey", _call(df, V.add, "day", V.literal(5)).alias("due"))


@query("SELECT event_id, ts + INTERVAL 1500 MILLISECOND AS later FROM events")
def time_add_millis(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", _call(df, V.add, "ts", V.literal(1500)).cast("timestamp_ntz").alias("later"))


@query("SELECT doc_id, (string_split(source, 'c') || ['x'])[2] AS second, len(string_split(source, 'c') || ['x']) AS n FROM documents")
def array_append_index(spark, d):
    df = table(spark, d, "documents").withColumn("parts", F.split("source", "c"))
    df = df.withColumn("more", _call(df, V.add, "parts", V.literal("x")))
    return df.select("doc_id", _call(df, V.index, "more", V.literal(1)).alias("second"), _call(df, V.length, "more").alias("n"))


@query("SELECT n_nationkey, substr(n_name, 2, 1) AS letter, CASE WHEN length(n_name) > 7 THEN substr(n_name, 8, 1) END AS eighth FROM nation")
def text_index(spark, d):
    df = table(spark, d, "nation")
    return df.select("n_nationkey", _call(df, V.index, "n_name", V.literal(1)).alias("letter"), _call(df, V.index, "n_name", V.literal(7)).alias("eighth"))


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def text_length(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", _call(df, V.length, "text").alias("n_bytes"))


@query("""SELECT l_linestatus, sum(l_quantity)::DOUBLE AS total, max(l_shipdate::DATE) AS latest, bool_and(l_quantity > 0) AS every FROM lineitem GROUP BY l_linestatus""")
def accumulate(spark, d):
    df = table(spark, d, "lineitem").withColumn("positive", F.col("l_quantity") > 0)
    return df.groupBy("l_linestatus").agg(V.add_assign(typed(df, "l_quantity")).col.cast("double").alias("total"), F.max(F.col("l_shipdate").cast("date")).alias("latest"), V.add_assign(typed(df, "positive")).col.alias("every"))


@query("""SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, value > 0 AS truthy, event_type AS word, epoch_us(ts) // 1000 AS ms FROM events""")
def coercions(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", _call(df, V.as_int, "value").alias("whole"), _call(df, V.as_bool, "value").alias("truthy"), _call(df, V.as_text, "event_type").alias("word"), _call(df, V.as_int, "ts").alias("ms"))


# ---------------------------------------------------------------- filter, unwind, collect


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_equal(spark, d):
    plan = Filter(Call("=", (Field("o_orderstatus"), Literal("F"))), Project((("o_orderkey", Field("o_orderkey")), ("o_orderstatus", Field("o_orderstatus")))))
    return plan.apply(table(spark, d, "orders"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def filter_gt(spark, d):
    plan = Project((("o_orderkey", Field("o_orderkey")), ("o_totalprice", Field("o_totalprice"))), Filter(Call(">", (Field("o_totalprice"), Literal(1000))), Scan()))
    return plan.apply(table(spark, d, "orders"))


@query("SELECT event_id, value FROM events WHERE value > 0")
def filter_truthy(spark, d):
    plan = Project((("event_id", Field("event_id")), ("value", Field("value"))), Filter(Field("value")))
    return plan.apply(table(spark, d, "events"))


@query("SELECT doc_id, unnest(string_split(source, 'c')) AS part FROM documents")
def unwind_array(spark, d):
    return Unwind("part").apply(table(spark, d, "documents").select("doc_id", F.split("source", "c").alias("part")))


@query("SELECT n_nationkey, unnest(string_split(n_name, '')) AS n_name FROM nation")
def unwind_text(spark, d):
    return Unwind("n_name").apply(table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT n_nationkey, unnest(string_split(w, '')) AS word FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w FROM nation)")
def unwind_nested(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.split("n_name", " ").alias("word"))
    return Unwind("word", Unwind("word")).apply(df)


@query("SELECT unnest(string_split(n_name, '')) || 'test' AS tagged FROM nation")
def unwind_project(spark, d):
    plan = Project((("tagged", Call("+", (Field("n_name"), Literal("test")))),), Unwind("n_name"))
    return plan.apply(table(spark, d, "nation"))


@query("SELECT event_type, len(list(event_id)) AS n, list_sort(list(event_id))[1] AS first_id, list_sort(list(event_id))[-1] AS last_id FROM events GROUP BY event_type")
def collect_values(spark, d):
    df = Collect("event_id", ("event_type",)).apply(table(spark, d, "events"))
    return df.select("event_type", F.size("values").cast("bigint").alias("n"), F.get("values", F.lit(0)).alias("first_id"), F.element_at("values", -1).alias("last_id"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_brand = 'Brand#13'")
def filter_chain(spark, d):
    plan = Project((("p_partkey", Field("p_partkey")), ("p_name", Field("p_name"))), Filter(Call("=", (Field("p_brand"), Literal("Brand#13"))), Passthrough("no rewrite yet", Filter(Call(">", (Field("p_size"), Literal(10)))))))
    return plan.apply(table(spark, d, "part"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000")
def sql_join_two_sources(spark, d):
    plan = parse("sql", "SELECT o_orderkey, c_name FROM bought JOIN buyers ON o_custkey = c_custkey WHERE o_totalprice > 1000")
    return plan.apply({"bought": table(spark, d, "orders"), "buyers": table(spark, d, "customer")})


@query("""SELECT c_nationkey, list_sort(list(c_mktsegment))[-1] AS top, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey""")
def accumulate_dictionary(spark, d):
    df = table(spark, d, "customer").withColumn("m", F.create_map("c_mktsegment", F.col("c_nationkey")))
    df = V.largest_entries(df, ["c_nationkey"], "m")
    out = df.groupBy("c_nationkey").agg(V.add_assign(typed(df, "m")).col.alias("m"))
    return out.select("c_nationkey", F.array_max(F.map_keys("m")).alias("top"), F.size("m").cast("bigint").alias("n"))


# ---------------------------------------------------------------- documents and graphs


@query("SELECT c_custkey, c_name AS label FROM customer")
def mql_project_include(spark, d):
    return table(spark, d, "customer").transform(Query("mql", "db.$$source.aggregate([{$project: {c_custkey: 1, label: '$c_name'}}])"))


@query("SELECT * EXCLUDE (c_acctbal) FROM customer")
def mql_project_exclude(spark, d):
    return table(spark, d, "customer").transform(Query("mql", "db.$$source.aggregate([{$project: {c_acctbal: 0}}])"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 10")
def mql_match(spark, d):
    return table(spark, d, "events").transform(Query("mql", 'db.$$source.aggregate([{$match: {event_type: "click", value: {$gt: 10}}}, {$project: {event_id: 1, value: 1}}])'))


@query("SELECT json_extract_string(props, '$.k') AS k FROM events")
def mql_json_field(spark, d):
    return table(spark, d, "events").select(F.try_parse_json("props").alias("doc")).transform(Query("mql", "db.$$source.aggregate([{$project: {k: 1}}])"))


@query("SELECT user_id::VARCHAR AS user_id, value::VARCHAR = value::VARCHAR AS known FROM events WHERE event_type = 'click'")
def cypher_match_return(spark, d):
    nodes = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.array("event_type").alias("labels"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("known"), F.col("value").isNotNull().cast("string")).alias("properties")
    )
    out = nodes.transform(Query("cypher", "MATCH (n:$$source:click) RETURN n.user_id, n.known"))
    return out.withColumn("known", F.col("known").cast("boolean"))


def _customers(spark, d) -> DataFrame:
    df = table(spark, d, "customer")
    return df.select("c_custkey", F.to_variant_object(F.struct(F.col("c_custkey").alias("id"), F.lit("Customer").alias("label"), F.struct("c_name", "c_nationkey").alias("properties"))).alias("value"))


@query("SELECT c_custkey, c_custkey AS id, 'Customer' AS label FROM customer")
def map_document(spark, d):
    df = _customers(spark, d).select("c_custkey", M.document(F.col("value")).alias("v"))
    return df.select("c_custkey", F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.label", "string").alias("label"))


@query("SELECT c_name AS name, c_nationkey AS age, c_acctbal AS price FROM customer")
def map_relational(spark, d):
    spec = [{"name": "TEXT"}, {"age": "INT"}, {"price": "FLOAT"}]
    df = table(spark, d, "customer").select(F.to_variant_object(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("age"), F.col("c_acctbal").alias("price"))).alias("value"))
    return df.select(M.Mapping.of("relational", spec).column(F.col("value")).alias("row")).select("row.*")


@query("SELECT c_custkey AS id, 'Customer' AS label, c_name AS name FROM customer")
def map_node(spark, d):
    df = _customers(spark, d).select(M.node(F.col("value")).alias("n"))
    return df.select("n.id", F.get("n.labels", F.lit(0)).alias("label"), F.col("n.properties")["c_name"].alias("name"))


@query("SELECT o_orderkey AS id, 'ORDERED' AS label, o_custkey AS \"start\", o_orderkey AS \"end\", o_orderstatus AS status FROM orders")
def map_edge(spark, d):
    raw = F.struct(F.col("o_orderkey").alias("id"), F.lit("ORDERED").alias("label"), F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.struct(F.col("o_orderstatus").alias("status")).alias("properties"))
    df = table(spark, d, "orders").select(M.edge(F.to_variant_object(raw)).alias("e"))
    return df.select("e.id", "e.label", "e.start", "e.end", F.col("e.properties")["status"].alias("status"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def map_key_value(spark, d):
    df = _customers(spark, d).select(M.key_value(F.col("value"), "id").alias("kv"))
    return df.select(F.col("kv.key").cast("bigint").alias("key"), F.try_variant_get("kv.value", "$.properties.c_name", "string").alias("name"))


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer")
def map_document_key(spark, d):
    df = _customers(spark, d).select("c_custkey", M.Mapping.of("document", {"key": "properties"}).column(F.col("value")).alias("v"))
    return df.select("c_custkey", F.try_variant_get("v", "$.c_name", "string").alias("name"), F.try_variant_get("v", "$.c_nationkey", "int").alias("nation"))


@query("SELECT n_nationkey, n_name AS first, n_regionkey::VARCHAR AS second FROM nation")
def map_document_list(spark, d):
    raw = F.parse_json(F.to_json(F.array("n_name", F.col("n_regionkey").cast("string"))))
    df = table(spark, d, "nation").select("n_nationkey", M.Mapping.of("document", {"list": ["first", "second"]}).column(raw).alias("v"))
    return df.select("n_nationkey", *[F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("first", "second")])


@query('SELECT o_orderkey AS id, o_custkey AS "start", o_custkey % 10 AS "end" FROM orders WHERE o_custkey < 20')
def map_subgraph(spark, d):
    orders = table(spark, d, "orders")
    nodes = spark.range(20).select(F.col("id"))
    edges = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("start"), (F.col("o_custkey") % 10).alias("end"))
    return M.subgraph(nodes, edges)[1].select("id", "start", "end")


# ---------------------------------------------------------------- routing


def _definition(name: str, take) -> Definition:
    return Definition(name, take, "document", Entity(name), M.Mapping.of("document", "document"), Query("sql", "SELECT value FROM $$source"))


def _records(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", F.array("event_type").alias("topics"), F.to_variant_object(F.struct("event_type", "user_id")).alias("value"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS definition FROM events")
def route_topic(spark, d):
    return route(_records(spark, d), [_definition("click", Topic("click")), _definition("view", Topic("view"))]).select("event_id", "definition")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'rest' END AS definition FROM events")
def route_key_equals(spark, d):
    return route(_records(spark, d), [_definition("clicks", KeyEquals("event_type", "click")), _definition("rest", TakeAll())]).select("event_id", "definition")


@query("SELECT event_id, 'all' AS definition FROM events")
def route_all(spark, d):
    return route(_records(spark, d), [_definition("all", TakeAll()), _definition("never", Topic("click"))]).select("event_id", "definition")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def read_back_by_ids(spark, d):
    from quern.sources.messages import read_by_ids

    ids = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return read_by_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


# ---------------------------------------------------------------- figures


@query('SELECT event_type, count(*) AS "rows" FROM events GROUP BY event_type')
def stage_row_counts(spark, d):
    return stage_counts(table(spark, d, "events"), "event_type")


@query("SELECT event_type, round(count(*) / floor(date_diff('microsecond', min(ts), max(ts)) / 1000000), 3) AS per_second FROM events GROUP BY event_type")
def throughput_per_type(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("s"))
    return g.select("event_type", throughput(F.col("n"), F.col("s")).alias("per_second"))


@query("SELECT user_id, CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 10 THEN 'middle' ELSE 'high' END AS load FROM events GROUP BY user_id")
def load_class_per_user(spark, d):
    return stage_counts(table(spark, d, "events"), "user_id").select("user_id", load_class(F.col("rows")).alias("load"))


@query("SELECT l_returnflag, avg(epoch_ms(l_shipdate) - epoch_ms(o_orderdate))::DOUBLE AS delay_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def stage_delay(spark, d):
    events = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return delay(events, "o_orderdate", "l_shipdate", "l_returnflag")


@query("SELECT count(*) AS \"open\", max(epoch_ms(TIMESTAMP '2030-01-01') - epoch_us(ts) // 1000) AS oldest_ms FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def unfinished_ids(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return open_ids(events, events.filter("event_type = 'click'"), F.lit("2030-01-01").cast("timestamp"), "event_id")


# ---------------------------------------------------------------- change records and streams


@query("SELECT user_id::VARCHAR AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def cdc_apply(spark, d):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
    action = F.when(F.col("event_type") == "click", "d").otherwise("u")
    raw = table(spark, d, "events").select("event_id", F.to_json(F.struct(action.alias("action"), F.array(pair("user_id", "user_id")).alias("identity"), F.array(pair("user_id", "user_id"), pair("value", "value")).alias("columns"))).alias("value"))
    return apply_changes(parse_changes(raw), "user_id", "event_id").select("key", F.col("value")["value"].cast("double").alias("value"))


@query("SELECT event_id, event_type AS topic, value::VARCHAR = value::VARCHAR AS there FROM events WHERE event_id % 3 <> 0")
def parse_broker_messages(spark, d):
    good = F.to_json(F.struct(F.array("event_type").alias("topics"), F.col("value").cast("string").alias("value")))
    raw = table(spark, d, "events").select(F.struct("event_id").alias("key"), F.when(F.col("event_id") % 3 != 0, good).otherwise("{broken").alias("value"), "event_id")
    return parse_messages(raw, keep=["event_id"]).select("event_id", F.get("topics", F.lit(0)).alias("topic"), F.col("value").isNotNull().alias("there"))


@query("SELECT event_id, props AS payload, 'in/' || event_type AS topic FROM events")
def mqtt_values(spark, d):
    df = table(spark, d, "events").select("event_id", mqtt_value(F.col("props").cast("binary"), F.concat(F.lit("in/"), F.col("event_type"))).alias("v"))
    return df.select("event_id", F.col("v.`$`").alias("payload"), F.col("v.`$topic`").alias("topic"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'update' WHEN 'error' THEN 'other' ELSE 'insert' END AS op,
  user_id::VARCHAR AS key, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events""")
def cdc_documents(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "click", "delete").when(kind == "view", "replace").when(kind == "error", "rename").otherwise("insert")
    doc = F.when(kind != "click", F.struct(F.col("user_id").cast("string").alias("_id"), kind.alias("kind")))
    raw = table(spark, d, "events").select("event_id", F.to_json(F.struct(op.alias("operationType"), F.struct(F.col("user_id").cast("string").alias("_id")).alias("documentKey"), doc.alias("fullDocument"))).alias("value"))
    return parse_document_changes(raw).select("event_id", "op", F.col("identity")["_id"].alias("key"), F.col("value")["kind"].alias("kind"))


@query("SELECT event_id, event_type AS topic, user_id, epoch_us(ts) // 1000 AS ms FROM events")
def wire_round_trip(spark, d):
    value = F.struct("event_id", "user_id")
    df = table(spark, d, "events")
    sent = df.select(to_wire(value, F.array("event_type"), F.col("ts").cast("timestamp")).alias("m"))
    back = sent.select(from_wire(F.col("m"), df.select(value.alias("v")).schema["v"].dataType).alias("m"))
    return back.select("m.value.event_id", F.get("m.topics", F.lit(0)).alias("topic"), "m.value.user_id", F.unix_millis("m.timestamp").alias("ms"))


@query("""SELECT w AS window_start, event_type, count(*) AS n
FROM (SELECT event_type, unnest([time_bucket(INTERVAL 10 SECOND, ts), time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 20 SECOND]) AS w FROM events)
GROUP BY ALL""")
def hopping_window_count(spark, d):
    df = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.groupBy(F.window("ts", "30 seconds", "10 seconds").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
