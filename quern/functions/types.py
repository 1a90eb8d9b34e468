"""Type names of configuration files, and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: A point in time with nanoseconds, which Spark's timestamps do not hold.
EXACT_TIME = T.StructType([T.StructField("ms", T.LongType()), T.StructField("ns", T.IntegerType())])

_NAMES = {
    ("int", "integer", "i"): T.LongType(),
    ("float", "f"): T.DoubleType(),
    ("bool", "boolean", "b"): T.BooleanType(),
    ("text", "string", "s"): T.StringType(),
    ("time",): T.TimestampType(),
    ("date",): T.DateType(),
    ("array",): T.ArrayType(T.VariantType()),
    ("dict",): T.MapType(T.StringType(), T.VariantType()),
    ("node",): NODE,
    ("edge",): EDGE,
    ("null",): T.NullType(),
    ("any",): T.VariantType(),
}
BY_NAME = {name: kind for names, kind in _NAMES.items() for name in names}


def parse_type(name: str) -> T.DataType:
    """``INT``, ``text``, ``varchar(20)`` and so on; unknown names raise ValueError."""
    key = name.strip().lower()
    if m := re.fullmatch(r"varchar\s*\(\s*(\d+)\s*\)", key):
        return T.VarcharType(int(m[1]))
    if key in BY_NAME:
        return BY_NAME[key]
    raise ValueError(f"unknown type name: {name!r}")


def ddl(name: str, kind: T.DataType) -> str:
    """One column of a table definition."""
    return f"`{name}` {kind.simpleString()}"


def schema_of(columns: list[dict[str, str]]) -> T.StructType:
    """The shorthand of relational mappings: a list of one-key tables ``{name = type}``."""
    fields = []
    for entry in columns:
        if len(entry) != 1:
            raise ValueError(f"one name per entry is expected: {entry!r}")
        ((name, kind),) = entry.items()
        fields.append(T.StructField(name, parse_type(kind)))
    if len({f.name for f in fields}) != len(fields):
        raise ValueError("a column name is used twice")
    return T.StructType(fields)
