"""Query texts by language."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from quern.plans.algebra import PlanError
from quern.plans.cypher import parse_cypher
from quern.plans.mql import parse_mql
from quern.plans.sql import parse_sql

LANGUAGES = {"sql": parse_sql, "mql": parse_mql, "cypher": parse_cypher}


def parse(language: str, text: str):
    """A plan; PlanError for an unknown language or a form that isn't supported."""
    if (key := language.lower()) not in LANGUAGES:
        raise PlanError(f"unknown query language {language!r}")
    return LANGUAGES[key](text)


@dataclass(frozen=True)
class Query:
    """A DataFrame transformation: ``df.transform(Query("sql", "SELECT ..."))``."""

    language: str
    text: str

    @cached_property
    def plan(self):
        return parse(self.language, self.text)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.plan.apply(df)
