"""quern: a Spark-first engine for routed record streams over relational, document and graph models."""

__version__ = "0.1.0"
