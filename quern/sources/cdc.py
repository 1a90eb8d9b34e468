"""Change records: parsing to one event shape, and applying them to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMN = "struct<name:string,value:string>"
CHANGE = f"action string, schema string, `table` string, columns array<{_COLUMN}>, identity array<{_COLUMN}>"
_ACTIONS = {"I": "insert", "U": "update", "D": "delete", "B": "begin", "C": "end", "i": "insert", "u": "update", "d": "delete", "b": "begin", "c": "end"}
_DOCUMENT_OPS = {"insert": "insert", "update": "update", "replace": "update", "delete": "delete"}


def _pick(code: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), F.lit("other"))


def _pairs(items: Column) -> Column:
    """name -> value; of a repeated name the last counts."""
    names = F.array_distinct(F.transform(items, lambda x: x["name"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(items, lambda x: x["name"] == n), -1)["value"]))
    return F.when(F.size(names) == F.size(items), F.map_from_entries(items)).otherwise(last)


def parse_changes(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Relational change rows (``action`` i/u/d/b/c) as op, identity and value maps; unknown actions are ``other``."""
    others = [c for c in raw.columns if c != payload]
    # a generator of one row keeps the optimizer from parsing once for every use
    m = F.explode(F.array(F.from_json(F.col(payload).cast("string"), CHANGE)))
    kept = raw.select(*others, m.alias("_m")).filter(F.col("_m.action").isNotNull())
    return kept.select(*others, _pick(F.col("_m.action"), _ACTIONS).alias("op"), _pairs(F.col("_m.identity")).alias("identity"), _pairs(F.col("_m.columns")).alias("value"))


def parse_document_changes(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Change-stream documents: operationType, documentKey, fullDocument."""
    v = F.try_parse_json(F.col(payload).cast("string"))
    others = [c for c in raw.columns if c != payload]
    kept = raw.withColumn("_v", v).filter(F.try_variant_get("_v", "$.operationType", "string").isNotNull())
    return kept.select(
        *others,
        _pick(F.try_variant_get("_v", "$.operationType", "string"), _DOCUMENT_OPS).alias("op"),
        F.try_variant_get("_v", "$.documentKey", "map<string,string>").alias("identity"),
        F.try_variant_get("_v", "$.fullDocument", "map<string,string>").alias("value"),
    )


def apply_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The state after the changes: the last insert or update of each key, unless a delete came later."""
    k = F.coalesce(F.col("identity")[key], F.col("value")[key])
    last = changes.filter(F.col("op").isin("insert", "update", "delete")).groupBy(k.alias("key")).agg(F.max_by(F.struct("op", "value"), F.col(order)).alias("last"))
    return last.filter(F.col("last.op") != "delete").select("key", F.col("last.value").alias("value"))
