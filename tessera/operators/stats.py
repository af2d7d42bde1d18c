"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col, require, user_columns
from ..functions.numbers import grid_number
from ..functions.types import is_numeric, type_name
from .quantiles import runs_of, statistics

_CUTS = (0.25, 0.5, 0.75)


def column_stats(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """One row of statistics of a numeric column; ``count`` includes missing values."""
    require(df, column)
    if not is_numeric(df.schema[column].dataType):
        raise ValueError(f"{column} is not numeric")
    return descriptive_stats(df.select(col(column)), approx)


def descriptive_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """A row of statistics for every numeric column, from one pass over the table.

    The pass counts runs of equal values, from which all else is told; with
    ``approx``, one aggregation with sketches and no runs.
    """
    names = [c for c in user_columns(df) if is_numeric(df.schema[c].dataType)]
    if not names:
        raise ValueError("no numeric column")
    whole = lambda c: isinstance(df.schema[c].dataType, T.IntegralType)
    cells = [
        F.struct(F.lit(i).alias("p"), F.lit(c).alias("column_name"), col(c).cast("double").alias("v"), (col(c).cast("long") if whole(c) else F.lit(None).cast("long")).alias("w"))
        for i, c in enumerate(names)
    ]
    long = df.select(F.inline(F.array(*cells)))
    if approx:
        v = F.col("v")
        out = long.groupBy("p", "column_name").agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"),
            F.percentile_approx(v, F.array(*map(F.lit, _CUTS))).alias("q"), F.approx_count_distinct(v).alias("distinct"),
        )
    else:
        out = statistics(runs_of(long, ["p", "column_name"]), ["p", "column_name"], list(_CUTS))
    cut = lambda i, name: F.get("q", F.lit(i)).alias(name)
    rows = F.col("rows")
    return out.orderBy("p").select(
        "column_name", rows.alias("count"), (rows - F.col("n")).alias("missing"), "mean", cut(1, "median"), F.col("std").alias("std_dev"), F.col("low").alias("min"), F.col("high").alias("max"),
        cut(0, "q1"), cut(2, "q3"), F.col("distinct").alias("unique_count"),
    )


def selection_stats(block: DataFrame) -> DataFrame:
    """Count of the values of a block and, if all are numbers, their sum, mean, least and greatest.

    Texts are numbers by the rules of the grid (``0x10`` is 16, blank text 0, no
    type suffix); true and false count as 1 and 0.
    """
    names = user_columns(block)

    def cell(c: str) -> Column:
        kind = block.schema[c].dataType
        number = col(c).cast("double") if is_numeric(kind) else col(c).cast("int").cast("double") if isinstance(kind, T.BooleanType) else grid_number(col(c).cast("string"))
        return F.struct(col(c).isNotNull().alias("met"), F.when(col(c).isNotNull() & ~F.isnan(number), number).alias("x"))

    cells = block.select(F.inline(F.array(*map(cell, names)))) if names else block.select(F.lit(False).alias("met"), F.lit(None).cast("double").alias("x"))
    out = cells.agg(F.count_if("met").alias("count"), F.count("x").alias("n"), F.sum("x").alias("sum"), F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.select("count", *[F.when(F.col("n") == F.col("count"), F.col(c)).alias(c) for c in ("sum", "avg", "min", "max")])


def describe_dataset(df: DataFrame) -> DataFrame:
    """A row per column: place, name, type, row count and missing values."""
    names = user_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(i).alias("col_index"), F.lit(c).alias("col_name"), F.lit(type_name(df.schema[c].dataType)).alias("col_type"), F.col("rows").alias("row_count"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*cells)))


def dataset_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("col_count", F.lit(len(user_columns(df))))
