"""Value semantics over typed columns: coercions, arithmetic, comparison, indexing.

The operands' types are known when the plan is built, so every rule picks one Catalyst expression; nothing is
dispatched per row. Text that does not parse gives null where the rule tolerates it, and combinations without a meaning
raise :class:`ValueTypeError` while the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.types import EXACT_TIME


class ValueTypeError(TypeError):
    """The operation has no meaning for these types."""


@dataclass(frozen=True)
class TypedColumn:
    col: Column
    kind: T.DataType

    @property
    def is_int(self) -> bool:
        return isinstance(self.kind, T.IntegralType)

    @property
    def is_float(self) -> bool:
        return isinstance(self.kind, (T.FractionalType, T.DecimalType))

    @property
    def is_number(self) -> bool:
        return self.is_int or self.is_float

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, (T.StringType, T.VarcharType, T.CharType))

    @property
    def is_exact_time(self) -> bool:
        return isinstance(self.kind, T.StructType) and [f.name for f in self.kind] == ["ms", "ns"]

    @property
    def is_time(self) -> bool:
        return isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) or self.is_exact_time


def typed(df: DataFrame, col: Column | str) -> TypedColumn:
    """A column with the type that the analyzer gives it."""
    col = F.col(col) if isinstance(col, str) else col
    return TypedColumn(col, df.select(col.alias("x")).schema["x"].dataType)


def literal(value) -> TypedColumn:
    """A constant; ints and floats keep their kind (the SQL subset makes all its numbers floats beforehand)."""
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
    if type(value) not in kinds:
        raise ValueTypeError(f"no literal for {type(value).__name__}")
    kind = kinds[type(value)]
    return TypedColumn(F.lit(value).cast(kind), kind)


def _fail(what: str, *xs: TypedColumn):
    raise ValueTypeError(f"{what} is not defined for {', '.join(x.kind.simpleString() for x in xs)}")


def _instant(x: TypedColumn) -> Column:
    return x.col.cast("timestamp")


def exact_time(ms: Column, ns: Column) -> Column:
    """(ms, ns) with whole milliseconds carried from ns."""
    ns = ns.cast("long")
    return F.struct((ms.cast("long") + F.floor(ns / 1_000_000)).alias("ms"), F.pmod(ns, F.lit(1_000_000)).cast("int").alias("ns"))


def as_int(x: TypedColumn) -> TypedColumn:
    c = x.col
    if x.is_exact_time:
        out = c["ms"]
    elif x.is_time:
        out = F.unix_millis(_instant(x))
    elif isinstance(x.kind, T.DateType):
        out = F.unix_date(c)
    elif x.is_number or isinstance(x.kind, (T.BooleanType, T.NullType)):
        out = c.cast("bigint")
    elif x.is_text:
        out = c.try_cast("bigint")
    else:
        _fail("as_int", x)
    return TypedColumn(out.cast("bigint"), T.LongType())


def as_float(x: TypedColumn) -> TypedColumn:
    if x.is_exact_time:
        out = x.col["ms"] + x.col["ns"] / F.lit(1e6)
    elif x.is_time:
        out = F.unix_micros(_instant(x)) / F.lit(1e3)
    elif isinstance(x.kind, T.DateType):
        out = F.unix_date(x.col)
    elif x.is_text:
        out = x.col.try_cast("double")
    elif x.is_number or isinstance(x.kind, (T.BooleanType, T.NullType)):
        out = x.col
    else:
        _fail("as_float", x)
    return TypedColumn(out.cast("double"), T.DoubleType())


def as_bool(x: TypedColumn) -> TypedColumn:
    """Truthiness: positive numbers, times and dates, ``true`` or ``1`` as text, containers that hold something; null is false."""
    c = x.col
    if isinstance(x.kind, T.BooleanType):
        out = c
    elif isinstance(x.kind, T.NullType):
        out = F.lit(False)
    elif x.is_text:
        out = F.lower(F.trim(c)).isin("true", "1")
    elif isinstance(x.kind, (T.ArrayType, T.MapType)):
        out = F.size(c) > 0
    elif x.is_number or x.is_time or isinstance(x.kind, T.DateType):
        out = as_float(x).col > 0
    elif isinstance(x.kind, T.StructType):
        out = c.isNotNull()
    else:
        _fail("as_bool", x)
    return TypedColumn(F.coalesce(out, F.lit(False)), T.BooleanType())


def _float_text(c: Column) -> Column:
    """Digits without an exponent, and whole numbers without a fraction: 3.0 is 3, 1.5E7 is 15000000."""
    size = F.abs(c)
    digits = F.when((size >= 1e-15) & (size < 1e22), F.regexp_replace(c.cast("decimal(38,15)").cast("string"), r"\.?0+$", ""))
    return F.when(size < 1e-300, F.lit("0")).otherwise(F.coalesce(digits, c.cast("string")))


def as_text(x: TypedColumn) -> TypedColumn:
    """``[a,b]`` for arrays, ``[k:v,...]`` for dictionaries, ``null`` for null; floats as plain digits."""
    c = x.col
    if isinstance(x.kind, (T.FloatType, T.DoubleType)):
        c = _float_text(c.cast("double"))
    if isinstance(x.kind, T.ArrayType):
        each = lambda e: as_text(TypedColumn(e, x.kind.elementType)).col
        c = F.concat(F.lit("["), F.array_join(F.transform(c, each), ","), F.lit("]"))
    elif isinstance(x.kind, T.MapType):
        pair = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), as_text(TypedColumn(e["value"], x.kind.valueType)).col)
        c = F.concat(F.lit("["), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("]"))
    return TypedColumn(F.coalesce(c.cast("string"), F.lit("null")), T.StringType())


def as_time(x: TypedColumn) -> TypedColumn:
    """Ints are milliseconds, floats milliseconds with a fraction, text RFC 3339."""
    if x.is_exact_time:
        out = F.timestamp_micros(x.col["ms"] * 1000 + F.floor(x.col["ns"] / 1000))
    elif x.is_time:
        out = _instant(x)
    elif x.is_int:
        out = F.timestamp_millis(x.col)
    elif x.is_float:
        out = F.timestamp_micros((x.col * 1000).cast("long"))
    elif x.is_text:
        out = F.try_to_timestamp(x.col)
    else:
        _fail("as_time", x)
    return TypedColumn(out, T.TimestampType())


def as_date(x: TypedColumn) -> TypedColumn:
    if isinstance(x.kind, T.DateType):
        out = x.col
    elif x.is_number:
        out = F.date_from_unix_date(x.col.cast("int"))
    elif x.is_text:
        out = F.when(x.col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), x.col.try_cast("date"))
    else:
        _fail("as_date", x)
    return TypedColumn(out, T.DateType())


def as_array(x: TypedColumn) -> TypedColumn:
    if isinstance(x.kind, T.ArrayType):
        return x
    if isinstance(x.kind, T.VariantType):
        kind = T.ArrayType(T.VariantType())
        return TypedColumn(F.try_variant_get(x.col, "$", kind.simpleString()), kind)
    _fail("as_array", x)


def as_dict(x: TypedColumn) -> TypedColumn:
    if isinstance(x.kind, T.MapType):
        return x
    if isinstance(x.kind, T.VariantType):
        kind = T.MapType(T.StringType(), T.VariantType())
        return TypedColumn(F.try_variant_get(x.col, "$", kind.simpleString()), kind)
    _fail("as_dict", x)


def _has_fields(x: TypedColumn, names: set[str], what: str) -> TypedColumn:
    if isinstance(x.kind, T.StructType) and names <= {f.name for f in x.kind}:
        return x
    _fail(what, x)


def as_node(x: TypedColumn) -> TypedColumn:
    return _has_fields(x, {"id", "labels", "properties"}, "as_node")


def as_edge(x: TypedColumn) -> TypedColumn:
    return _has_fields(x, {"id", "label", "start", "end", "properties"}, "as_edge")


def coerce(x: TypedColumn, kind: T.DataType) -> TypedColumn:
    """x as the given type, by the rules above."""
    if isinstance(kind, T.IntegralType):
        return as_int(x)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return as_float(x)
    if isinstance(kind, T.BooleanType):
        return as_bool(x)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return as_text(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return as_time(x)
    if isinstance(kind, T.DateType):
        return as_date(x)
    if x.kind == kind:
        return x
    _fail("coercion", x, TypedColumn(F.lit(None), kind))


def _wide(x: TypedColumn) -> Column:
    return x.col.cast("double" if x.is_float else "bigint")


def _numeric(a: TypedColumn, b: TypedColumn, op) -> TypedColumn:
    if a.is_int and b.is_int:
        return TypedColumn(op(_wide(a), _wide(b)), T.LongType())
    return TypedColumn(op(a.col.cast("double"), b.col.cast("double")), T.DoubleType())


def add(a: TypedColumn, b: TypedColumn) -> TypedColumn:
    if a.is_number and b.is_number:
        return _numeric(a, b, lambda x, y: x + y)
    if a.is_text:
        return TypedColumn(F.concat(a.col, as_text(b).col), T.StringType())
    if a.is_exact_time:
        if b.is_exact_time:
            more = b.col
        else:
            ms = as_float(b).col
            more = F.struct(F.floor(ms).alias("ms"), F.round((ms - F.floor(ms)) * 1_000_000).cast("int").alias("ns"))
        return TypedColumn(exact_time(a.col["ms"] + more["ms"], a.col["ns"] + more["ns"]), EXACT_TIME)
    if a.is_time:
        micros = F.unix_micros(_instant(a)) + (as_float(b).col * 1000).cast("long")
        return TypedColumn(F.timestamp_micros(micros), T.TimestampType())
    if isinstance(a.kind, T.DateType):
        return TypedColumn(F.date_add(a.col, as_int(b).col.cast("int")), T.DateType())
    if isinstance(a.kind, T.ArrayType):
        if isinstance(a.kind.elementType, T.VariantType) and not isinstance(b.kind, T.VariantType):
            return TypedColumn(F.array_append(a.col, F.to_variant_object(b.col) if isinstance(b.kind, (T.StructType, T.ArrayType, T.MapType)) else b.col.cast("variant")), a.kind)
        return TypedColumn(F.array_append(a.col, coerce(b, a.kind.elementType).col), a.kind)
    _fail("+", a, b)


def minus(a: TypedColumn, b: TypedColumn) -> TypedColumn:
    if a.is_number and b.is_number:
        return _numeric(a, b, lambda x, y: x - y)
    if a.is_time and b.is_time and not (a.is_exact_time or b.is_exact_time):
        return TypedColumn(as_int(a).col - as_int(b).col, T.LongType())
    _fail("-", a, b)


def multiply(a: TypedColumn, b: TypedColumn) -> TypedColumn:
    if a.is_number and b.is_number:
        return _numeric(a, b, lambda x, y: x * y)
    if a.is_text and b.is_int:
        return TypedColumn(F.repeat(a.col, b.col.cast("int")), T.StringType())
    _fail("*", a, b)


def divide(a: TypedColumn, b: TypedColumn) -> TypedColumn:
    """Always a float; x / 0 is an infinity of x's sign, 0 / 0 is NaN."""
    if not (a.is_number and b.is_number):
        _fail("/", a, b)
    x, y = a.col.cast("double"), b.col.cast("double")
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return TypedColumn(F.when(y == 0, at_zero).otherwise(F.try_divide(x, y)), T.DoubleType())


def equal(a: TypedColumn, b: TypedColumn) -> TypedColumn:
    """Null-safe; numbers compare as floats, else the right side takes the left side's type first."""
    if a.is_number and b.is_number:
        out = a.col.eqNullSafe(b.col)
    elif isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
        out = a.col.isNull() & b.col.isNull()
    else:
        # text of a null is 'null', which must not equal the word
        out = F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(a.col.eqNullSafe(coerce(b, a.kind).col))
    return TypedColumn(out, T.BooleanType())


def gt(a: TypedColumn, b: TypedColumn) -> TypedColumn:
    """Numbers by value; null is below everything, so the result is never null."""
    if isinstance(a.kind, T.NullType):
        return TypedColumn(F.lit(False), T.BooleanType())
    right = b if (a.is_number and b.is_number) or a.kind == b.kind or isinstance(b.kind, T.NullType) else coerce(b, a.kind)
    out = F.when(a.col.isNull(), F.lit(False)).when(b.col.isNull(), F.lit(True)).otherwise(F.coalesce(a.col > right.col, F.lit(False)))
    return TypedColumn(out, T.BooleanType())


def kept_by(x: TypedColumn) -> Column:
    """A predicate for filters, where null and false are the same: plain comparisons, which reach the scan."""
    if isinstance(x.kind, T.BooleanType):
        return x.col
    return x.col > 0 if x.is_number else as_bool(x).col


def comparable(a: TypedColumn, b: TypedColumn) -> bool:
    """Whether the two compare as they are, without a coercion."""
    return (a.is_number and b.is_number) or (a.is_text and b.is_text) or (a.kind == b.kind and isinstance(a.kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)))


def index(a: TypedColumn, i: TypedColumn) -> TypedColumn:
    """0-based element or code point; null out of range."""
    at = as_int(i).col.cast("int")
    if isinstance(a.kind, T.ArrayType):
        return TypedColumn(F.get(a.col, at), a.kind.elementType)
    if a.is_text:
        inside = (at >= 0) & (at < F.char_length(a.col))
        return TypedColumn(F.when(inside, F.substring(a.col, at + 1, F.lit(1))), T.StringType())
    if isinstance(a.kind, T.MapType):
        return TypedColumn(F.try_element_at(a.col, i.col), a.kind.valueType)
    _fail("index", a, i)


def length(a: TypedColumn) -> TypedColumn:
    """Elements of an array, bytes of a text."""
    if isinstance(a.kind, (T.ArrayType, T.MapType)):
        return TypedColumn(F.size(a.col).cast("bigint"), T.LongType())
    if a.is_text:
        return TypedColumn(F.octet_length(a.col).cast("bigint"), T.LongType())
    _fail("length", a)


def elements(a: TypedColumn) -> TypedColumn:
    """What unwinding walks over: an array's elements, or a text's code points."""
    if isinstance(a.kind, T.ArrayType):
        return a
    if a.is_text:
        return TypedColumn(F.filter(F.split(a.col, ""), lambda c: c != ""), T.ArrayType(T.StringType()))
    _fail("explode", a)


def add_assign(a: TypedColumn) -> TypedColumn:
    """The accumulating form of +, as an aggregate; nulls do nothing."""
    if a.is_number:
        return TypedColumn(F.sum(a.col.cast("double" if a.is_float else "bigint")), T.DoubleType() if a.is_float else T.LongType())
    if isinstance(a.kind, T.BooleanType):
        return TypedColumn(F.bool_and(a.col), a.kind)
    if a.is_text:
        return TypedColumn(F.array_join(F.sort_array(F.collect_list(a.col)), ""), T.StringType())
    if isinstance(a.kind, T.ArrayType):
        return TypedColumn(F.flatten(F.sort_array(F.collect_list(a.col))), a.kind)
    if isinstance(a.kind, T.MapType):
        # of a key that several hold the largest value stays, whatever the order of arrival
        # bound to s, the entries are sorted once; an expression inside a lambda is computed anew for each element
        entries = F.sort_array(F.flatten(F.collect_list(F.map_entries(a.col))))
        last = F.transform(F.array(entries), lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["key"] != e["key"], F.lit(True))))
        return TypedColumn(F.map_from_entries(F.get(last, F.lit(0))), a.kind)
    if isinstance(a.kind, T.DateType):
        return TypedColumn(F.date_from_unix_date(F.sum(F.unix_date(a.col)).cast("int")), a.kind)
    if a.is_time and not a.is_exact_time:
        return TypedColumn(F.timestamp_micros(F.sum(F.unix_micros(_instant(a)))), T.TimestampType())
    _fail("+=", a)


def largest_entries(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """A dictionary for each group and key, with the largest value: add_assign gives the same of these, and no group has to be in one place before."""
    key = f"{name} key"
    entries = df.select(*by, F.explode_outer(F.map_entries(name)).alias(name))
    largest = entries.groupBy(*by, F.col(name)["key"].alias(key)).agg(F.max(F.col(name)["value"]).alias(name))
    return largest.select(*by, F.when(F.col(key).isNotNull(), F.create_map(key, name)).alias(name))


#: Operators by the name that plans use; those of two operands first.
BINARY = {"+": add, "-": minus, "*": multiply, "/": divide, "=": equal, ">": gt, "index": index}
UNARY = {"length": length, "elements": elements, "as_int": as_int, "as_float": as_float, "as_bool": as_bool, "as_text": as_text, "as_time": as_time, "as_date": as_date}
