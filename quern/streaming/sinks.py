"""Where the three layers of a definition go. Files are written under their batch id, so a replayed batch replaces itself;
other stores get the batch id as a column, and each sink says what a replay does there."""

from __future__ import annotations

import socket
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ParquetSink:
    """Folders ``<root>/<table>/batch=<id>``; files hold at most rows_per_file rows."""

    root: str
    rows_per_file: int = 1_000_000

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.root}/{table}/batch={batch}")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{table}")


def storable(df: DataFrame, nested: bool) -> DataFrame:
    """Columns that other stores have types for: a column with a VARIANT in it becomes JSON text, and without ``nested``
    arrays, maps and structs do too."""

    def variant(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(variant(f.dataType) for f in kind)
        if isinstance(kind, T.MapType):
            return variant(kind.keyType) or variant(kind.valueType)
        return variant(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.VariantType)

    def column(f: T.StructField) -> Column:
        name = F.col("`" + f.name.replace("`", "``") + "`")
        text = variant(f.dataType) or (not nested and isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType))
        return F.to_json(name).alias(f.name) if text else name

    return df.select(*map(column, df.schema))


@dataclass(frozen=True)
class JdbcSink:
    """A relational store; needs its driver on the class path. A replayed batch first deletes its earlier rows."""

    url: str
    options: dict = field(default_factory=dict)
    rows_per_insert: int = 1000
    #: The column that tells batches apart.
    batch: str = "batch"

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        self._forget(df.sparkSession, table, batch)
        rows = storable(df, nested=False).withColumn(self.batch, F.lit(batch).cast("long"))
        writer = rows.write.format("jdbc").mode("append").option("url", self.url).option("dbtable", table).option("batchsize", self.rows_per_insert)
        writer.options(**self.options).save()

    def _forget(self, spark: SparkSession, table: str, batch: int) -> None:
        """Deletes a batch's rows, if the table is there."""
        jvm = spark._jvm
        dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)
        own = jvm.java.util.Properties()
        for key, text in self.options.items():
            own.setProperty(key, str(text))
        driver = self.options.get("driver") or jvm.java.sql.DriverManager.getDriver(self.url).getClass().getName()
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        peer = jvm.java.sql.DriverManager.getConnection(self.url, own)
        try:
            statement = peer.createStatement()
            try:
                statement.execute(dialect.getTableExistsQuery(table))
            except Py4JJavaError:
                return
            statement.executeUpdate(f"DELETE FROM {table} WHERE {dialect.quoteIdentifier(self.batch)} = {int(batch)}")
        finally:
            peer.close()


@dataclass(frozen=True)
class ConnectorSink:
    """Any other store with a Spark connector, such as a document or graph database. A replayed batch is appended again,
    but for tables that a ``Ledger`` has as done."""

    format: str
    options: dict = field(default_factory=dict)
    table_option: str = "collection"

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        rows = storable(df, nested=True).withColumn("batch", F.lit(batch).cast("long"))
        rows.write.format(self.format).mode("append").options(**self.options).option(self.table_option, table).save()


@dataclass(frozen=True)
class Ledger:
    """A sink whose batches are noted in a shared folder once they are written, and passed over when they are replayed: for
    stores that cannot replace a batch. What fails between write and note is written again."""

    sink: object
    root: str

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        note = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/batch={batch}")
        fs = note.getFileSystem(conf)
        if not fs.exists(note):
            self.sink.write(df, table, batch)
            fs.create(note, True).close()


@dataclass
class TopicFeed:
    """Hands all processed rows of one topic to a listener as JSON lines, one partition at a time."""

    topic: str
    send: object

    def write(self, native: DataFrame, query) -> None:
        """A definition's query over its records of the topic: a query that merges records merges those of the topic only."""
        rows = query(native.filter(F.array_contains("topics", self.topic)))
        for line in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
            self.send(line["line"])


@dataclass
class TcpFeed:
    """Hands processed rows of one topic to a listener on a socket, a JSON line each."""

    topic: str
    host: str
    port: int
    timeout: float = 10.0

    def write(self, native: DataFrame, query) -> None:
        with socket.create_connection((self.host, self.port), self.timeout) as peer:
            TopicFeed(self.topic, lambda line: peer.sendall(line.encode() + b"\n")).write(native, query)


@dataclass(frozen=True)
class KafkaSink:
    """A broker's topic for each table; needs the connector on the class path. A replayed batch is sent again, under the
    same keys, so a compacted topic keeps one."""

    servers: str
    prefix: str = ""
    options: dict = field(default_factory=dict)

    def frame(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        """topic, key, value as the connector takes them."""
        line = F.to_json(F.struct("*"))
        key = F.concat_ws("-", F.lit(batch).cast("string"), F.xxhash64(line).cast("string"))
        return df.select(F.lit(self.prefix + table).alias("topic"), key.alias("key"), line.alias("value"))

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        self.frame(df, table, batch).write.format("kafka").option("kafka.bootstrap.servers", self.servers).options(**self.options).save()


@dataclass(frozen=True)
class GraphSink:
    """Nodes and edges in tables of their own, ``<table>_nodes`` and ``<table>_edges``; what isn't a graph goes on as it is."""

    sink: object

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        fields = df.schema["value"].dataType.names if "value" in df.columns and isinstance(df.schema["value"].dataType, T.StructType) else []
        if {"id", "labels"} <= set(fields):
            self.sink.write(nodes(df), f"{table}_nodes", batch)
        elif {"id", "start", "end"} <= set(fields):
            self.sink.write(edges(df), f"{table}_edges", batch)
        else:
            self.sink.write(df, table, batch)


def nodes(df: DataFrame, column: str = "value") -> DataFrame:
    """One flat row for each node struct."""
    return df.filter(F.col(column).isNotNull()).select(f"{column}.id", f"{column}.labels", f"{column}.properties")


def edges(df: DataFrame, column: str = "value") -> DataFrame:
    """One flat row for each edge struct that has both ends."""
    v = F.col(column)
    return df.filter(v["start"].isNotNull() & v["end"].isNotNull()).select(*[v[c].alias(c) for c in ("id", "label", "start", "end", "properties")])


def to_wire(value: Column, topics: Column, timestamp: Column) -> Column:
    """A message for other processes, as JSON text."""
    return F.to_json(F.struct(topics.alias("topics"), value.alias("value"), F.unix_millis(timestamp).alias("timestamp")))


def from_wire(message: Column, kind: T.DataType) -> Column:
    """The message's topics, value of the given type, and timestamp; null for text that isn't one."""
    schema = T.StructType([T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("value", kind), T.StructField("timestamp", T.LongType())])
    m = F.from_json(message, schema)
    return F.when(m["topics"].isNotNull(), F.struct(m["topics"].alias("topics"), m["value"].alias("value"), F.timestamp_millis(m["timestamp"]).alias("timestamp")))
