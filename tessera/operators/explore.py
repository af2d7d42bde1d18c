"""Shape, correlation and histogram statistics, typed predicates, missing values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import absent, col, require, user_columns
from ..functions.types import is_numeric


def _numeric(df: DataFrame, names: list[str] | None) -> list[str]:
    names = list(names or [c for c in user_columns(df) if is_numeric(df.schema[c].dataType)])
    require(df, *names)
    for c in names:
        if not is_numeric(df.schema[c].dataType):
            raise ValueError(f"{c} is not numeric")
    return names


def shape_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis of numeric columns, in one pass; missing values are left out."""
    names = _numeric(df, columns)
    cells = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(c).alias("column_name"), col(c).cast("double").alias("v")) for i, c in enumerate(names)])
    long = df.select(F.inline(cells))
    return long.groupBy("p", "column_name").agg(F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis")).orderBy("p").drop("p")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns (rows with both values), in one aggregation."""
    pairs = list(combinations(_numeric(df, columns), 2))
    if not pairs:
        raise ValueError("two numeric columns at least")
    one = df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """``value``, ``count`` and ``percent`` of every distinct value; missing is a value (eager: counts the rows first)."""
    require(df, column)
    total = max(df.count(), 1)
    return df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).withColumn("percent", 100.0 * F.col("count") / F.lit(total))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin`` (from 1), its lower edge and its count, over equal widths from the least to the greatest value.

    Every bin is listed, the last one holds the greatest value; eager: reads the
    bounds first.  NaN is in no bin.  A column without values, or with one value,
has one bin.
    """
    (name,) = _numeric(df, [column])
    x = col(name).cast("double")
    low, high = df.where(~F.isnan(x)).agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        return df.where(x.isNull() | ~F.isnan(x)).select(F.lit(1).alias("bin"), F.lit(low).cast("double").alias("low"), F.when(x.isNotNull(), 1).alias("k")).groupBy("bin", "low").agg(F.count("k").alias("count"))
    width = (high - low) / bins
    place = F.least(F.floor((x - low) / width).cast("int") + 1, F.lit(bins))
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + (F.col("bin") - 1) * width).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def predicate(name: str, test: str, value=None) -> Column:
    """A typed filter: eq, neq, gt, gte, lt, lte, contains, is_null, not_null."""
    c = col(name)
    tests = {
        "eq": lambda: c == value, "neq": lambda: c != value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value,
        "contains": lambda: F.contains(c.cast("string"), F.lit(str(value))), "is_null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
    }
    if test not in tests:
        raise ValueError(f"unknown test {test!r}")
    return tests[test]()


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    require(df, *values)
    return df.select(*[F.coalesce(col(c), F.lit(values[c]).cast(df.schema[c].dataType)).alias(c) if c in values else col(c) for c in df.columns])


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that have a value in each of the columns (all, if none)."""
    names = list(columns or user_columns(df))
    require(df, *names)
    out = df
    for c in names:
        out = out.where(col(c).isNotNull())
    return out


def computed_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A new column from a SQL expression over the others."""
    absent(df, name)
    return df.withColumn(name, F.expr(expression))
