"""Definitions and stores from TOML text."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from quern.operators.mapping import Mapping
from quern.operators.routing import MODELS, Definition, Entity, KeyEquals, TakeAll, Topic
from quern.plans.query import LANGUAGES, Query


def _filter(spec):
    if spec in (None, "all", {}):
        return TakeAll()
    if isinstance(spec, dict) and "topic" in spec:
        return Topic(spec["topic"])
    if isinstance(spec, dict) and "key" in spec:
        ((key, text),) = spec["key"].items()
        return KeyEquals(key, text)
    raise ValueError(f"unknown filter {spec!r}")


def definition(name: str, spec: dict) -> Definition:
    model = MODELS.get(str(spec["model"]).lower())
    if model is None:
        raise ValueError(f"unknown model {spec['model']!r}")
    languages = [k for k in spec["processing"] if k in LANGUAGES]
    if len(languages) != 1:
        raise ValueError(f"{name}: one query is expected")
    query = Query(languages[0], spec["processing"][languages[0]])
    query.plan  # noqa: B018  a bad query fails when it is loaded
    mapping = spec.get("mapping", {})
    return Definition(name, _filter(spec.get("filter")), model, Entity(spec["entity"]), Mapping.of(model, mapping.get(model, "document" if model == "document" else None)), query, spec.get("topic", ""))


@dataclass
class Catalog:
    """What a running pipeline knows: definitions in order, and stores by name with their model."""

    definitions: dict[str, Definition] = field(default_factory=dict)
    stores: dict[str, str] = field(default_factory=dict)

    def add(self, d: Definition) -> None:
        if d.id in self.definitions:
            raise ValueError(f"definition {d.id!r} exists")
        self.definitions[d.id] = d

    def add_store(self, name: str, model: str) -> None:
        self.stores[name] = MODELS[model.lower()]


def load(text: str) -> Catalog:
    doc, out = tomllib.loads(text), Catalog()
    for name, spec in doc.get("def", {}).items():
        out.add(definition(name, spec))
    for name, spec in doc.get("store", {}).items():
        out.add_store(name, spec["model"])
    return out
