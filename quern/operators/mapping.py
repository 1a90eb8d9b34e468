"""Mappings from raw values to the shape that a model stores.

A mapping has producers in three ranks: initial, then manual, then auto; the first that matches a value wins, and a value
that none matches becomes null. Input values are VARIANT columns (dynamic) or structs (declared).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.types import schema_of


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _path(key: str) -> str:
    return f'$["{key}"]' if not key.isidentifier() else f"$.{key}"


def document(value: Column) -> Column:
    """The whole value if it is a dictionary."""
    return F.when(_is_object(value), value)


def document_key(value: Column, key: str) -> Column:
    """The value under a key; null where there is none."""
    return F.try_variant_get(value, _path(key), "variant")


def document_list(value: Column, keys: list[str]) -> Column:
    """A dictionary of the keys and an array's elements, in order."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(_is_array(value), F.to_variant_object(F.map_from_arrays(F.array(*map(F.lit, keys)), F.transform(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda i: F.get(items, i)))))


def relational(value: Column, schema: T.StructType) -> Column:
    """A row of the declared types, from an array by position or a dictionary by name; else null."""
    by_name = F.struct(*[F.try_variant_get(value, _path(f.name), f.dataType.simpleString()).alias(f.name) for f in schema])
    by_place = F.struct(*[F.try_variant_get(value, f"$[{i}]", f.dataType.simpleString()).alias(f.name) for i, f in enumerate(schema)])
    return F.when(_is_array(value), by_place).when(_is_object(value), by_name)


def node(value: Column, id_key: str = "id", label_key: str = "label", properties_key: str = "properties") -> Column:
    """A bad id is 0, a missing label gives no labels, bad properties are empty."""
    label = F.try_variant_get(value, _path(label_key), "string")
    props = F.try_variant_get(value, _path(properties_key), "map<string,string>")
    out = F.struct(
        F.coalesce(F.try_variant_get(value, _path(id_key), "bigint"), F.lit(0).cast("bigint")).alias("id"),
        F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.coalesce(props, F.create_map().cast("map<string,string>")).alias("properties"),
    )
    return F.when(_is_object(value), out)


def edge(value: Column, id_key: str = "id", label_key: str = "label", source_key: str = "source", target_key: str = "target", properties_key: str = "properties") -> Column:
    """Ends come from the source and target keys."""
    whole = lambda k: F.try_variant_get(value, _path(k), "bigint")
    out = F.struct(
        F.coalesce(whole(id_key), F.lit(0).cast("bigint")).alias("id"),
        F.try_variant_get(value, _path(label_key), "string").alias("label"),
        whole(source_key).alias("start"),
        whole(target_key).alias("end"),
        F.coalesce(F.try_variant_get(value, _path(properties_key), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("properties"),
    )
    return F.when(_is_object(value), out)


def subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges whose two ends are among them."""
    ids = nodes.select(F.col("id").alias("_node")).distinct()
    inside = edges.join(ids, edges["start"] == ids["_node"], "left_semi").join(ids, F.col("end") == ids["_node"], "left_semi")
    return nodes, inside


def key_value(value: Column, key: str) -> Column:
    return F.struct(F.try_variant_get(value, _path(key), "string").alias("key"), value.alias("value"))


_GRAPH_KEYS = {"node": {"id": "id_key", "label": "label_key", "properties": "properties_key"}, "edge": {"id": "id_key", "label": "label_key", "source": "source_key", "target": "target_key", "properties": "properties_key"}}


def producer(model: str, spec):
    """A function of the value column, from one entry of a configuration."""
    if model == "document":
        if spec == "document":
            return document
        if isinstance(spec, dict) and "key" in spec:
            return lambda v: document_key(v, spec["key"])
        if isinstance(spec, dict) and "list" in spec:
            return lambda v: document_list(v, list(spec["list"]))
    elif model == "relational" and isinstance(spec, list):
        schema = schema_of(spec)
        return lambda v: relational(v, schema)
    elif model == "graph" and isinstance(spec, dict) and len(spec) == 1:
        ((kind, keys),) = spec.items()
        if kind in _GRAPH_KEYS:
            named = {_GRAPH_KEYS[kind][k]: x.get("doc", {}).get("key", k) if isinstance(x, dict) else str(x) for k, x in keys.items()}
            return lambda v: (node if kind == "node" else edge)(v, **named)
    elif model in ("keyvalue", "key_value") and isinstance(spec, dict) and "key" in spec:
        return lambda v: key_value(v, spec["key"])
    raise ValueError(f"no {model} mapping for {spec!r}")


@dataclass(frozen=True)
class Mapping:
    model: str
    initial: object
    manual: tuple = ()
    auto: tuple = ()

    @classmethod
    def of(cls, model: str, spec) -> Mapping:
        """A shorthand, or ``{initial, manual, auto}``; only documents have the last two."""
        if isinstance(spec, dict) and "initial" in spec:
            more = {k: tuple(x if isinstance(x := spec.get(k, []), list) else [x]) for k in ("manual", "auto")}
            if model != "document" and any(more.values()):
                raise ValueError("manual and auto mappings are for documents")
            return cls(model, spec["initial"], **more)
        return cls(model, spec)

    def column(self, value: Column) -> Column:
        return F.coalesce(*[producer(self.model, s)(value) for s in (self.initial, *self.manual, *self.auto)])

    @property
    def schema(self) -> T.StructType | None:
        """Declared columns, for relational mappings."""
        return schema_of(self.initial) if self.model == "relational" else None
