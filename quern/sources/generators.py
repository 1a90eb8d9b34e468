"""Sources that make up records: a constant value at a fixed pace, or at one that slows down."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def interval_source(spark: SparkSession, topic: str, value: str, rows_per_second: int = 100) -> DataFrame:
    """A stream of one JSON value on one topic, as columns topics and value (VARIANT)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.array(F.lit(topic)).alias("topics"), F.parse_json(F.lit(value)).alias("value"), "timestamp")


class _RampingReader(SimpleDataSourceStreamReader):
    """Offsets are (records sent, due time of the next in seconds, current interval)."""

    def __init__(self, options):
        self.topic = options.get("topic", "")
        self.value = options.get("value", "null")
        self.first = float(options.get("intervalMs", "10")) / 1000
        self.delta = float(options.get("deltaMs", "1")) / 1000
        self.burst = int(options.get("maxPerBatch", "10000"))

    def initialOffset(self):
        return {"n": 0, "due": time.time(), "gap": self.first}

    def _step(self, at: dict) -> dict:
        gap = at["gap"]
        return {"n": at["n"] + 1, "due": at["due"] + gap, "gap": max(0.0, gap + self.delta)}

    def read(self, start):
        at, rows, now = start, [], time.time()
        while at["due"] <= now and len(rows) < self.burst:
            rows.append((at["n"], self.topic, self.value))
            at = self._step(at)
        return iter(rows), at

    def readBetweenOffsets(self, start, end):
        return iter([(n, self.topic, self.value) for n in range(start["n"], end["n"])])


class RampingSource(DataSource):
    """``spark.readStream.format("ramping")`` with options topic, value, intervalMs, deltaMs: each gap is deltaMs longer."""

    @classmethod
    def name(cls):
        return "ramping"

    def schema(self):
        return "n bigint, topic string, value string"

    def simpleStreamReader(self, schema):
        return _RampingReader(self.options)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(RampingSource)
