"""Document queries: ``db.<collection>.aggregate([{stage}, ...])`` with a relaxed JSON payload.

``$project`` includes (1), excludes (0) or renames ("$path" or "name"); ``$match`` compares for equality or with $gt,
$gte, $lt, $lte, $ne and $in; ``$unwind`` explodes; ``$limit`` and ``$sort`` do as they say. An unknown stage raises.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import values
from quern.plans.algebra import Exclude, Field, PlanError, Project, Scan, Scope, Unwind

_COMMAND = re.compile(r"\s*db\.(?P<source>[\w$]+)\.aggregate\s*\((?P<stages>.*)\)\s*;?\s*\Z", re.S)
_WORD = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//[^\n]*|/\*.*?\*/|(?P<key>[A-Za-z_$][\w$.]*)(?=\s*:)|(?P<comma>,)(?=\s*[\]}])", re.S)


def relaxed_json(text: str):
    """JSON with bare keys, single quotes, comments and trailing commas."""

    def fix(m: re.Match) -> str:
        whole = m[0]
        if m["key"]:
            return json.dumps(m["key"])
        if m["comma"] or whole.startswith("/"):
            return ""
        if whole[0] == "'":
            return json.dumps(whole[1:-1].replace("\\'", "'"))
        return whole

    try:
        # a second pass finds commas that stood before a comment
        return json.loads(_WORD.sub(fix, _WORD.sub(fix, text)))
    except ValueError as e:
        raise PlanError(f"bad payload: {e}") from e


_TESTS = {
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$ne": lambda c, v: ~c.eqNullSafe(v),
    "$eq": lambda c, v: c.eqNullSafe(v),
    "$in": lambda c, v: c.isin(v),
}


@dataclass(frozen=True)
class Match:
    conditions: tuple
    input: object

    @property
    def scope(self) -> Scope:
        return self.input.scope

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        keep: Column = F.lit(True)
        for name, test in self.conditions:
            x = Field(name).bind(df)
            tests = test if isinstance(test, dict) else {"$eq": test}
            for op, value in tests.items():
                if op not in _TESTS:
                    raise PlanError(f"unknown test {op!r}")
                number = isinstance(value, (int, float)) and not isinstance(value, bool)
                keep &= _TESTS[op](values.as_float(x).col if number and x.is_text else x.col, value)
        return df.filter(keep)

    def sql(self) -> str:
        return f"MATCH({self.input.sql()})"


@dataclass(frozen=True)
class Ordered:
    """``$sort`` and ``$limit``."""

    keys: tuple
    limit: int | None
    input: object

    scope = Scope.MULTI

    def apply(self, sources) -> DataFrame:
        df = self.input.apply(sources)
        if self.keys:
            df = df.orderBy(*[F.col(k).asc() if way >= 0 else F.col(k).desc() for k, way in self.keys])
        return df if self.limit is None else df.limit(self.limit)

    def sql(self) -> str:
        return self.input.sql()


def _projection(key: str, value):
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, int):
        return key, (Field(key) if value == 1 else Exclude(key))
    if isinstance(value, str):
        return key, Field(value.removeprefix("$"))
    raise PlanError(f"no projection of {key!r} as {value!r}")


def parse_mql(text: str):
    if not (m := _COMMAND.match(text)):
        raise PlanError("db.<collection>.aggregate([...]) is expected")
    stages = relaxed_json(m["stages"])
    if not isinstance(stages, list):
        raise PlanError("a list of stages is expected")
    plan = Scan(m["source"])
    for stage in stages:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise PlanError(f"a stage has one key: {stage!r}")
        ((name, body),) = stage.items()
        if name == "$project" and isinstance(body, dict) and body:
            plan = Project(tuple(_projection(k, v) for k, v in body.items()), plan)
        elif name in ("$match", "$filter") and isinstance(body, dict):
            plan = Match(tuple(body.items()), plan)
        elif name == "$unwind" and isinstance(body, str):
            plan = Unwind(body.removeprefix("$"), plan)
        elif name == "$sort" and isinstance(body, dict):
            plan = Ordered(tuple(body.items()), None, plan)
        elif name == "$limit" and isinstance(body, int):
            plan = Ordered((), body, plan)
        else:
            raise PlanError(f"unknown stage {name!r}")
    return plan
