"""Messages from brokers, and reading stored rows back by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "topics array<string>, value string"


def parse_messages(raw: DataFrame, payload: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON ``{topics: [...], value: "..."}``, beside the columns to keep; a payload that does not parse, or lacks topics, is skipped."""
    parsed = F.from_json(F.col(payload).cast("string"), MESSAGE, {"mode": "PERMISSIVE"})
    return raw.select(*(keep or []), parsed.alias("m")).filter(F.col("m.topics").isNotNull()).select(*(keep or []), "m.topics", "m.value")


def kafka_source(spark: SparkSession, servers: str, topic: str = "poly", group: str | None = None, rows_per_batch: int = 100_000) -> DataFrame:
    """Earliest-first stream of messages, a bounded number a batch; the connector's jar has to be on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", rows_per_batch)
    if group:
        reader = reader.option("kafka.group.id", group)
    return parse_messages(reader.load())


def mqtt_value(payload: Column, topic: Column) -> Column:
    """A broker message as a dictionary: ``$`` is the payload and ``$topic`` its topic."""
    return F.struct(payload.cast("string").alias("$"), topic.alias("$topic"))


def read_by_ids(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is listed. The optimizer broadcasts the list only while its measured size permits."""
    return store.join(ids.select(key).distinct(), key, "left_semi")
