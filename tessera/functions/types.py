"""Type names, the common-type lattice and checked conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import sql_double, sql_whole

#: The type names a user can choose.
TYPES: dict[str, T.DataType] = {
    "VARCHAR": T.StringType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}

#: A whole date with one kind of separator, and perhaps a time of day and an offset (which is ignored).
_DAY = r"^\s*([0-9]{1,4})([-/ ])([0-9]{1,2})\2([0-9]{1,2})"
_MOMENT = _DAY + r"([ T]+([0-9]{1,2}):([0-9]{1,2})(:([0-9]{1,2})(\.[0-9]*)?)?\s*(Z|UTC|[+-][0-9]{1,2}(:?[0-9]{2})?)?)?\s*$"
_RANK = {"BOOLEAN": 0, "INTEGER": 1, "BIGINT": 2, "DOUBLE": 3}


def spark_type(name: str) -> T.DataType:
    if name.upper() not in TYPES:
        raise ValueError(f"unknown type {name!r}; use one of {', '.join(TYPES)}")
    return TYPES[name.upper()]


def type_name(kind: T.DataType) -> str:
    """The user-visible name of a Spark type; other numeric types count as DOUBLE, the rest as VARCHAR."""
    for name, known in TYPES.items():
        if type(kind) is type(known):
            return name
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return "INTEGER"
    if isinstance(kind, T.NumericType):
        return "DOUBLE"
    return "TIMESTAMP" if isinstance(kind, T.TimestampType) else "VARCHAR"


def common_type(names: list[str]) -> str:
    """The type that holds values of all the given types."""

    def two(a: str, b: str) -> str:
        if a == b:
            return a
        if "VARCHAR" in (a, b):
            return "VARCHAR"
        if a in _RANK and b in _RANK:
            return max(a, b, key=_RANK.__getitem__)
        if {a, b} == {"DATE", "TIMESTAMP"}:
            return "TIMESTAMP"
        raise ValueError(f"no common type of {a} and {b}")

    return reduce(two, names)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def convert(column: Column, source: T.DataType, target: str) -> Column:
    """``column`` as ``target``; null where the value does not convert.

    Doubles become integers by rounding half to even, decimal texts by rounding
    half away from zero.  Texts are numbers as in SQL (no type suffix; ``0x`` for
    whole numbers only), and dates only if they are whole: year, month and day
    between equal separators (``-``, ``/`` or a blank), perhaps with a time.
    """
    kind = spark_type(target)
    if target in ("INTEGER", "BIGINT"):
        if isinstance(source, (T.DoubleType, T.FloatType)):
            return F.bround(column).try_cast(kind)
        if isinstance(source, T.StringType):
            return sql_whole(column, kind.simpleString())
    if target == "DOUBLE" and isinstance(source, T.StringType):
        return sql_double(column)
    if target in ("DATE", "TIMESTAMP") and isinstance(source, T.StringType):
        return _moment(column, kind)
    if target == "BOOLEAN" and is_numeric(source):
        return column != 0
    return column.try_cast(kind)


def _moment(text: Column, kind: T.DataType) -> Column:
    part = lambda i: F.regexp_extract(text, _MOMENT, i)
    two = lambda i: F.lpad(F.when(part(i) == "", "0").otherwise(part(i)), 2, "0")
    day = F.concat(F.lpad(part(1), 4, "0"), F.lit("-"), two(3), F.lit("-"), two(4))
    fraction = F.when(F.length(part(10)) > 1, F.substring(part(10), 1, 7)).otherwise("")
    clock = F.concat(two(6), F.lit(":"), two(7), F.lit(":"), two(9), fraction)
    moment = F.concat(day, F.lit(" "), clock).try_cast(T.TimestampNTZType())
    return F.when(text.rlike(_MOMENT), moment.cast(kind))
