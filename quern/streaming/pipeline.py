"""From a source of (topics, value) to three stored layers for each definition.

A batch is stamped, routed, stored raw (plain), mapped (native) and queried (process). The same steps run on a static
DataFrame and inside foreachBatch; the path has no shuffle but what a definition's own query asks for.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Catalog
from quern.operators.routing import Definition, route, store_for

META = ["id", "ts", "topics"]


def stamp(df: DataFrame, batch: int) -> DataFrame:
    """Ids are unique in a stream and not gap-free: the batch's number and the row's place; ts is the ingest time."""
    row = F.monotonically_increasing_id()
    ts = F.col("ts") if "ts" in df.columns else F.current_timestamp()
    return df.withColumn("id", F.struct(F.lit(batch).cast("bigint").alias("batch"), row.alias("row"))).withColumn("ts", ts)


def mapped(df: DataFrame, d: Definition) -> DataFrame:
    """The native layer: mapped value beside the record's own metadata."""
    return df.select(*META, d.mapping.column(F.col("value")).alias("value"))


def processed(native: DataFrame, d: Definition) -> DataFrame:
    """The definition's query over the native layer's columns."""
    if d.model == "relational":
        flat = native.select("value.*")
    elif d.model == "graph":
        flat = native.select("value.*")
    else:
        flat = native.select("value")
    return d.query(flat)


@dataclass
class Pipeline:
    catalog: Catalog
    #: One sink for all, or sinks by the names of the catalog's stores.
    sink: object
    feeds: list = field(default_factory=list)
    #: Of stores by name, where they differ from 1.
    costs: dict[str, float] = field(default_factory=dict)
    #: Definitions whose layers are written at the same time; one's small writes fill what another's leave idle.
    parallel: int = 4

    def sink_of(self, d: Definition | None):
        """The sink of the cheapest store for the definition's model; dead letters go to the first."""
        if not isinstance(self.sink, dict):
            return self.sink
        if d is None:
            return self.sink[next(iter(sorted(self.sink)))]
        return self.sink[store_for(d.model, {k: v for k, v in self.catalog.stores.items() if k in self.sink}, self.costs)]

    def run_batch(self, df: DataFrame, batch: int = 0) -> None:
        """Stores a batch. A definition that fails fails the batch, after the others have ended."""
        definitions = list(self.catalog.definitions.values())
        ready = route(stamp(df, batch), definitions).persist()
        try:
            with ThreadPoolExecutor(max(1, self.parallel)) as pool:
                session = inheritable_thread_target(df.sparkSession)
                jobs = [pool.submit(session(self._store), ready, d, batch) for d in [*definitions, None]]
            for job in jobs:
                job.result()
            for d in definitions if self.feeds else ():
                native = mapped(ready.filter(F.col("definition") == d.id), d)
                for feed in self.feeds:
                    feed.write(native, lambda df, d=d: processed(df, d))
        finally:
            ready.unpersist()

    def _store(self, ready: DataFrame, d: Definition | None, batch: int) -> None:
        """The three layers of a definition, or the dead letters."""
        sink = self.sink_of(d)
        if d is None:
            sink.write(ready.filter(F.col("definition").isNull()).drop("definition"), "dead_letters", batch)
            return
        own = ready.filter(F.col("definition") == d.id).drop("definition")
        native = mapped(own, d)
        sink.write(own, d.entity.plain, batch)
        sink.write(native, d.entity.native, batch)
        sink.write(processed(native, d), d.entity.process, batch)

    def start(self, stream: DataFrame, checkpoint: str, interval: str = "500 milliseconds", available_now: bool = False):
        """A streaming query that can be stopped and restarted from its checkpoint."""
        writer = stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()
