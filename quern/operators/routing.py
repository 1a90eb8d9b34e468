"""Definitions, and the routing of records to the first definition that takes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.mapping import Mapping
from quern.plans.query import Query

MODELS = {"document": "document", "doc": "document", "relational": "relational", "rel": "relational", "graph": "graph", "keyvalue": "key_value", "key_value": "key_value"}


@dataclass(frozen=True)
class Entity:
    """Names of the three tables of a definition."""

    name: str

    @property
    def plain(self) -> str:
        return f"{self.name}_plain"

    @property
    def native(self) -> str:
        return f"{self.name}_native"

    @property
    def process(self) -> str:
        return self.name


@dataclass(frozen=True)
class TakeAll:
    def column(self, topics: Column, value: Column | None) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Topic:
    name: str

    def column(self, topics: Column, value: Column | None) -> Column:
        return F.coalesce(F.array_contains(topics, self.name), F.lit(False))


@dataclass(frozen=True)
class KeyEquals:
    key: str
    text: str

    def column(self, topics: Column, value: Column | None) -> Column:
        return F.coalesce(F.try_variant_get(value, f"$.{self.key}", "string") == self.text, F.lit(False))


@dataclass(frozen=True)
class Definition:
    id: str
    filter: object
    model: str
    entity: Entity
    mapping: Mapping
    query: Query
    topic: str = ""


def route(df: DataFrame, definitions: list[Definition], topics: str = "topics", value: str | None = "value", to: str = "definition") -> DataFrame:
    """Adds the id of the first definition, in the order given, whose filter takes the row; null for dead letters."""
    val = F.col(value) if value else None
    return df.withColumn(to, F.coalesce(*[F.when(d.filter.column(F.col(topics), val), F.lit(d.id)) for d in definitions], F.lit(None).cast("string")))


def store_for(model: str, stores: dict[str, str], cost: dict[str, float] | None = None) -> str:
    """The cheapest store: a cost of 1 unless given, doubled when the store's model differs."""
    if not stores:
        raise ValueError("no stores")
    return min(sorted(stores), key=lambda s: (cost or {}).get(s, 1.0) * (1 if stores[s] == model else 2))
