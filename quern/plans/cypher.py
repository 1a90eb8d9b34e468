"""Graph queries: ``MATCH (n:source:Label) RETURN n.field [AS name], ...`` over a table of nodes.

The input has columns ``labels`` (array) and ``properties`` (map or struct or VARIANT); the label filters, and
everything after RETURN must parse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.algebra import PlanError, Scan, Scope

_NAME = r"[A-Za-z_$][\w$]*"
_MATCH = re.compile(rf"\s*MATCH\s*\(\s*(?P<alias>{_NAME})\s*:\s*(?P<source>{_NAME})\s*(?::\s*(?P<label>{_NAME})\s*)?\)\s*RETURN\s+(?P<out>.+?)\s*;?\s*\Z", re.S)
_ITEM = re.compile(rf"\s*(?P<alias>{_NAME})\s*\.\s*(?P<field>{_NAME})\s*(?:AS\s+(?P<name>{_NAME})\s*)?\Z", re.S)


@dataclass(frozen=True)
class MatchReturn:
    label: str | None
    fields: tuple[tuple[str, str], ...]
    input: object

    scope = Scope.TUPLE

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        if missing := {"labels", "properties"} - set(df.columns):
            raise PlanError(f"a table of nodes has {sorted(missing)}")
        if self.label:
            df = df.filter(F.array_contains("labels", self.label))
        kind = df.schema["properties"].dataType

        def of(name: str):
            if isinstance(kind, T.MapType):
                return F.try_element_at("properties", F.lit(name))
            if isinstance(kind, T.VariantType):
                return F.try_variant_get("properties", f"$.{name}", "string")
            return F.col(f"properties.`{name}`")

        return df.select(*[of(field).alias(name) for name, field in self.fields])

    def sql(self) -> str:
        where = f" WHERE array_contains(labels, '{self.label}')" if self.label else ""
        return f"SELECT {', '.join(f'properties.{f} AS {n}' for n, f in self.fields)} FROM {self.input.sql()}{where}"


def parse_cypher(text: str) -> MatchReturn:
    if not (m := _MATCH.match(text)):
        raise PlanError("MATCH (a:source:Label) RETURN a.field is expected")
    fields = []
    for part in m["out"].split(","):
        if not (item := _ITEM.match(part)):
            raise PlanError(f"cannot return {part.strip()!r}")
        if item["alias"] != m["alias"]:
            raise PlanError(f"{item['alias']!r} is not matched; {m['alias']!r} is")
        fields.append((item["name"] or item["field"], item["field"]))
    return MatchReturn(m["label"], tuple(fields), Scan(m["source"]))
