"""Logical plans that turn into DataFrames.

A plan is a small immutable tree. ``apply(source)`` lowers it to DataFrame operations, so that batch and streaming inputs
share one definition and Catalyst does pushdown, pruning and code generation. Fields resolve by name: a column of the
input, or a path into the one VARIANT column of a schemaless input.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import values
from quern.functions.values import TypedColumn, typed


class PlanError(ValueError):
    """The plan or the query text isn't supported."""


class Scope(Enum):
    """What a plan needs to see at once: one row, many rows, or several inputs."""

    TUPLE = 0
    MULTI = 1
    JOIN = 2


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Field:
    name: str

    def bind(self, df: DataFrame) -> TypedColumn:
        if self.name in df.columns:
            return typed(df, f"`{self.name}`")
        dynamic = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
        if len(dynamic) == 1:
            # an unknown type prints as text; callers cast when they need more
            path = "$." + self.name if self.name.isidentifier() else f'$["{self.name}"]'
            return TypedColumn(F.try_variant_get(F.col(dynamic[0]), path, "string"), T.StringType())
        raise PlanError(f"no field {self.name!r} among {df.columns}")

    def sql(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal:
    value: object

    def bind(self, df: DataFrame) -> TypedColumn:
        return values.literal(self.value)

    def sql(self) -> str:
        if isinstance(self.value, str):
            return "'" + self.value.replace("'", "''") + "'"
        return "NULL" if self.value is None else str(self.value)


#: How tightly infix operators bind.
_POWER = {"=": 1, ">": 1, "+": 2, "-": 2, "*": 3, "/": 3}


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple

    def bind(self, df: DataFrame) -> TypedColumn:
        bound = [a.bind(df) for a in self.args]
        for table, count in ((values.BINARY, 2), (values.UNARY, 1)):
            if self.op in table and len(bound) == count:
                return table[self.op](*bound)
        raise PlanError(f"no operator {self.op!r} of {len(bound)} operands")

    def sql(self) -> str:
        if self.op in _POWER and len(self.args) == 2:
            left, right = self.args
            inner = lambda e, least: f"({e.sql()})" if isinstance(e, Call) and _POWER.get(e.op, 9) < least else e.sql()
            return f"{inner(left, _POWER[self.op])} {self.op} {inner(right, _POWER[self.op] + 1)}"
        return f"{self.op}({', '.join(a.sql() for a in self.args)})"


@dataclass(frozen=True)
class Exclude:
    """Only in projections: every input column but this one."""

    name: str

    def sql(self) -> str:
        return f"* EXCEPT ({self.name})"


# ---------------------------------------------------------------- operators


@dataclass(frozen=True)
class Scan:
    source: str = "$$source"
    schema: T.StructType | None = None

    scope = Scope.TUPLE

    def apply(self, sources: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
        if isinstance(sources, DataFrame):
            sources = {self.source: sources}
        if self.source not in sources:
            raise PlanError(f"no source named {self.source!r}")
        df = sources[self.source]
        if self.schema is None:
            return df
        if missing := [f.name for f in self.schema if f.name not in df.columns]:
            raise PlanError(f"{self.source} lacks {missing}")
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])

    def sql(self) -> str:
        return self.source


@dataclass(frozen=True)
class Project:
    """Named expressions in order; a projection of exclusions keeps all the other columns."""

    expressions: tuple[tuple[str, object], ...]
    input: object = field(default_factory=Scan)

    @property
    def scope(self) -> Scope:
        return self.input.scope

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        gone = [e.name for _, e in self.expressions if isinstance(e, Exclude)]
        made = [(n, e) for n, e in self.expressions if not isinstance(e, Exclude)]
        if gone and made:
            raise PlanError("a projection either includes or excludes")
        if gone:
            return df.drop(*gone)
        return df.select(*[e.bind(df).col.alias(n) for n, e in made])

    def sql(self) -> str:
        shown = ", ".join(e.sql() if not isinstance(e, Call) and e.sql() == n else f"{e.sql()} AS {n}" for n, e in self.expressions)
        return f"SELECT {shown} FROM {_nested(self.input)}"


@dataclass(frozen=True)
class Filter:
    """Keeps rows whose predicate is truthy."""

    predicate: object
    input: object = field(default_factory=Scan)

    @property
    def scope(self) -> Scope:
        return self.input.scope

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        return df.filter(self._column(df))

    def _column(self, df: DataFrame):
        e = self.predicate
        if isinstance(e, Call) and e.op in ("=", ">") and isinstance(e.args[1], Literal) and e.args[1].value is not None:
            a, b = (x.bind(df) for x in e.args)
            if values.comparable(a, b):  # null on the left keeps no row either way
                return a.col == b.col if e.op == "=" else a.col > b.col
        return values.kept_by(e.bind(df))

    def sql(self) -> str:
        return f"SELECT * FROM {_nested(self.input)} WHERE {self.predicate.sql()}"


@dataclass(frozen=True)
class Unwind:
    """One row for each element of an array field or each code point of a text field, in place of the field."""

    key: str
    input: object = field(default_factory=Scan)
    keep_empty: bool = False

    scope = Scope.MULTI

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        each = values.elements(Field(self.key).bind(df)).col
        return df.withColumn(self.key, F.explode_outer(each) if self.keep_empty else F.explode(each))

    def sql(self) -> str:
        return f"UNWIND({_nested(self.input)}, {self.key})"


@dataclass(frozen=True)
class Collect:
    """Gathers a field into an array for each group, in ascending order so that runs agree."""

    key: str
    by: tuple[str, ...] = ()
    name: str = "values"
    input: object = field(default_factory=Scan)

    scope = Scope.MULTI

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        return df.groupBy(*self.by).agg(F.sort_array(F.collect_list(Field(self.key).bind(df).col)).alias(self.name))

    def sql(self) -> str:
        return f"COLLECT({_nested(self.input)}, {self.key})"


@dataclass(frozen=True)
class Passthrough:
    """A marked gap: hands its input on."""

    note: str = ""
    input: object = field(default_factory=Scan)

    @property
    def scope(self) -> Scope:
        return self.input.scope

    def apply(self, sources) -> DataFrame:
        return self.input.apply(sources)

    def sql(self) -> str:
        return self.input.sql()


def _nested(plan) -> str:
    return plan.sql() if isinstance(plan, (Scan, Passthrough)) else f"({plan.sql()})"
