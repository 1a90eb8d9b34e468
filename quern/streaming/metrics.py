"""Figures of running pipelines: row counts, delays, throughput, load classes."""

from __future__ import annotations

import json
import time
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def stage_counts(events: DataFrame, *by: str, count: str = "rows") -> DataFrame:
    """Rows for each store, definition and stage."""
    return events.groupBy(*by).agg(F.count("*").alias(count))


def throughput(count: Column, seconds: Column) -> Column:
    """Rows for each whole second, to three decimals; null for a time under one second."""
    whole = F.floor(seconds)
    return F.when(whole > 0, F.round(count / whole, 3))


def delay(events: DataFrame, start: str, at: str, *by: str) -> DataFrame:
    """Mean milliseconds from ingest to a stage."""
    return events.groupBy(*by).agg(F.avg(F.unix_millis(F.col(at).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp"))).alias("delay_ms"))


def open_ids(ingested: DataFrame, finished: DataFrame, now: Column, key: str = "id", ts: str = "ts") -> DataFrame:
    """How many ids are unfinished, and the age of the oldest in milliseconds."""
    left = ingested.join(finished.select(key).distinct(), key, "left_anti")
    return left.agg(F.count("*").alias("open"), F.max(F.unix_millis(now) - F.unix_millis(F.col(ts).cast("timestamp"))).alias("oldest_ms"))


def load_class(per_second: Column) -> Column:
    return F.when(per_second < 5, "low").when(per_second < 10, "middle").otherwise("high")


class Metrics(StreamingQueryListener):
    """Keeps totals of all queries of a session and hands each report on as a JSON line, at most one in ``every`` seconds for
    each query. A query that lies more than ``deep`` records behind its source reports at once, marked as ``deep``."""

    def __init__(self, send=None, every: float = 20.0, deep: int = 10_000):
        self.send, self.every, self.deep = send, every, deep
        self.rows, self.behind, self.alive, self._last = Counter(), {}, {}, {}

    def silent(self, seconds: float, now: float | None = None) -> list[str]:
        """Queries that run but were not heard of for so long."""
        now = time.time() if now is None else now
        return sorted(q for q, at in self.alive.items() if now - at > seconds)

    def onQueryStarted(self, event):
        self.alive[str(event.id)] = time.time()

    def onQueryProgress(self, event):
        p, now = event.progress, time.time()
        query = str(p.id)
        self.rows[query] += p.numInputRows
        self.alive[query] = now
        # brokers tell how far their worst partition is behind; other sources don't
        self.behind[query] = sum(int(float((s.metrics or {}).get("maxOffsetsBehindLatest", 0))) for s in p.sources)
        deep = self.behind[query] > self.deep
        if self.send and (deep or now - self._last.get(query, 0.0) >= self.every):
            self._last[query] = now
            self.send(json.dumps({"query": query, "batch": p.batchId, "rows": self.rows[query], "per_second": round(p.processedRowsPerSecond or 0, 3), "behind": self.behind[query], "deep": deep}))

    def onQueryIdle(self, event):
        self.alive[str(event.id)] = time.time()

    def onQueryTerminated(self, event):
        for kept in (self.alive, self.behind, self._last):
            kept.pop(str(event.id), None)
