"""Column filters and blocks of cells."""

from __future__ import annotations

import math
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ROW_ID, col, require, user_columns
from .places import by_id, ids_are_places


def rendering(name: str) -> Column:
    """The text of a cell; a missing one is empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def _typed(text: str, kind: T.DataType):
    """The one value that is shown as ``text``, or None."""
    try:
        if isinstance(kind, T.IntegralType):
            value = int(text)
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
            return value if str(value) == text and -(1 << bits - 1) <= value < 1 << bits - 1 else None
        if isinstance(kind, T.DateType):
            value = date.fromisoformat(text)
            return value if value.isoformat() == text else None
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(text)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = float(text)
            return None if math.isnan(value) else value
    except ValueError:
        return None
    return text


def discrete(name: str, values: list[str], kind: T.DataType | None = None) -> Column:
    """Rows whose text is one of ``values``.

    With the column's type the texts become typed values and null tests, which
    reach the scan; a text that no value is shown as finds nothing.
    """
    values = list(dict.fromkeys(values))
    text = rendering(name).isin(values)
    exact = (T.StringType, T.IntegralType, T.DateType, T.BooleanType)
    if kind is None or not isinstance(kind, (*exact, T.DoubleType, T.FloatType)) or "NaN" in values:
        return text
    wanted = [v for v in (_typed(t, kind) for t in values if t or isinstance(kind, T.StringType)) if v is not None]
    found = col(name).isin(wanted) if wanted else F.lit(False)
    found = found | col(name).isNull() if "" in values else found
    return found if isinstance(kind, exact) else found & text  # several texts are one number


def discrete_rows(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Rows whose text is in the first column of a (large) table of values; whole numbers and dates are joined as such."""
    kind = df.schema[name].dataType
    text = F.coalesce(values[0].cast("string"), F.lit(""))
    if not isinstance(kind, (T.IntegralType, T.DateType, T.BooleanType)):
        wanted = values.select(text.alias("__v")).distinct()
        return df.join(wanted, rendering(name) == F.col("__v"), "left_semi")
    typed = values.select(text.alias("__t"), text.try_cast(kind).alias("__v")).where((F.col("__t") == "") | (F.col("__v").cast("string") == F.col("__t"))).select("__v").distinct()
    return df.join(typed, col(name).eqNullSafe(F.col("__v")), "left_semi")


def _bound(value) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(number) else number


def value_range(name: str, low=None, high=None) -> Column:
    """Inclusive bounds; one that is empty or no number is ignored; null and NaN fail an active bound."""
    lo, hi = _bound(low), _bound(high)
    out = F.lit(True)
    if lo is not None:
        out = out & (col(name) >= lo)
    if hi is not None:
        out = out & (col(name) <= hi)
    return out if lo is None and hi is None else out & ~F.isnan(col(name))


def all_of(filters: list[Column]) -> Column:
    return reduce(and_, filters, F.lit(True))


def filter_counts(df: DataFrame, filters: list[Column]) -> DataFrame:
    """Filtered and total row counts, in one pass."""
    return df.agg(F.count_if(all_of(filters)).alias("filtered"), F.count(F.lit(1)).alias("total"))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """The distinct texts of a column, numbers first by value, then text."""
    require(df, name)
    found = df.select(rendering(name).alias("value")).distinct()
    number = F.regexp_extract("value", r"^\s*(-?\d+(\.\d+)?)", 1).try_cast("double")
    return found.orderBy(number.asc_nulls_last(), "value")


def slice_block(df: DataFrame, row_a: int, row_b: int, column_a: int, column_b: int) -> DataFrame:
    """The rectangle between two corners (1-based, inclusive, any order).

    Rows count by place in the order of their ids, whatever gaps those have: ids
    without gaps are filtered as they are, else the rows are sorted once.  For
    many rectangles of one table keep ``places.by_id`` of it.
    """
    rows, columns = sorted((row_a, row_b)), sorted((column_a, column_b))
    names = user_columns(df)[columns[0] - 1 : columns[1]]
    if ROW_ID in df.columns and ids_are_places(df):
        return df.where(F.col(ROW_ID).between(*rows)).select(*map(col, names))
    return by_id(df.select(*([ROW_ID] if ROW_ID in df.columns else []), *map(col, names))).between(*rows).select(*map(col, names))


def is_floating(df: DataFrame, name: str) -> bool:
    """Range filters are for these columns; all others filter by text."""
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
