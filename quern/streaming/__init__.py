from quern.streaming.metrics import Metrics, delay, load_class, open_ids, stage_counts, throughput
from quern.streaming.pipeline import Pipeline
from quern.streaming.sinks import ConnectorSink, GraphSink, JdbcSink, KafkaSink, Ledger, ParquetSink, TcpFeed, TopicFeed, from_wire, storable, to_wire

__all__ = ["ConnectorSink", "GraphSink", "JdbcSink", "KafkaSink", "Ledger", "Metrics", "ParquetSink", "Pipeline", "TcpFeed", "TopicFeed", "delay", "from_wire", "load_class", "open_ids", "stage_counts", "storable", "throughput", "to_wire"]
