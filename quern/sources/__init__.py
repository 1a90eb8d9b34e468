from quern.sources.cdc import apply_changes, parse_changes
from quern.sources.generators import RampingSource, interval_source, register_sources
from quern.sources.messages import kafka_source, mqtt_value, parse_messages, read_by_ids

__all__ = ["RampingSource", "apply_changes", "interval_source", "kafka_source", "mqtt_value", "parse_changes", "parse_messages", "read_by_ids", "register_sources"]
