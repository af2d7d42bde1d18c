"""Table operations: sort, page, subset, reshape, join, update, concatenate, summary."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.names import ROW_ID, col, distinct_names, require, user_columns
from ..functions.types import common_type, convert, is_numeric, spark_type, type_name
from .places import Ordered, ordered
from .quantiles import rank_quantiles, runs_of, statistics
from .rowid import assign_row_id

#: Statistic -> (suffix of the result column, aggregate).
STATISTICS = {
    "n": ("N", F.count),
    "mean": ("Mean", lambda c: F.avg(c.cast("double"))),
    "std": ("Std", lambda c: F.stddev_samp(c.cast("double"))),
    "min": ("Min", F.min),
    "max": ("Max", F.max),
    "sum": ("Sum", lambda c: F.sum(c.cast("double"))),
    "median": ("Median", None),  # by rank, see quantiles
}


def ordering(columns: list[str], orders: list[str]) -> list[Column]:
    """Sort keys with nulls last; the shorter list decides how many."""
    return [col(c).desc_nulls_last() if o.lower() == "desc" else col(c).asc_nulls_last() for c, o in zip(columns, orders)]


def sort(df: DataFrame, columns: list[str], orders: list[str]) -> DataFrame:
    """``df`` in order, with new row ids; equal rows keep the order of their old ids, if they have any."""
    require(df, *columns)
    keys = ordering(columns, orders) + ([col(ROW_ID).asc()] if ROW_ID in df.columns else [])
    return assign_row_id(df, *keys)


#: Rows up to the end of a page that one task may hold; a page further back is read from a sorted copy.
TOP_ROWS = 100_000


def page(df: DataFrame, number: int, size: int, sort_column: str | None = None, order: str = "asc") -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, by a sort column if given, then by row id.

    Pages near the start are a top-k; others come from a sorted copy of which
    only the parts with the page are read.  For many pages of one order keep
    ``paged`` of the table.
    """
    if (number + 1) * size <= TOP_ROWS:
        keys = _page_order(df, sort_column, order)
        return (df.orderBy(*keys) if keys else df).offset(number * size).limit(size)
    return paged(df, sort_column, order).page(number, size)


def _page_order(df: DataFrame, sort_column: str | None, order: str) -> list[Column]:
    if sort_column:
        require(df, sort_column)
    keys = ordering([sort_column], [order]) if sort_column else []
    return keys + ([col(ROW_ID).asc()] if ROW_ID in df.columns else [])


def paged(df: DataFrame, sort_column: str | None = None, order: str = "asc") -> Ordered:
    """``df`` sorted and stored once, for any number of pages and blocks."""
    return ordered(df, *_page_order(df, sort_column, order))


def top_k(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def subset(df: DataFrame, columns: list[str] | None = None, predicate: str | None = None) -> DataFrame:
    """Chosen columns (all, if none) of the rows for which a SQL predicate over any column holds."""
    columns = list(columns or user_columns(df))
    require(df, *columns)
    kept = df.where(F.expr(predicate)) if predicate and predicate.strip() else df
    return kept.select(*map(col, columns))


def as_type(df: DataFrame, name: str, target: str) -> Column:
    kind = df.schema[name].dataType
    return col(name) if kind == spark_type(target) else convert(col(name), kind, target)


def concatenate(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns by name in order of appearance, widened; absent ones null."""
    if not tables:
        raise ValueError("nothing to concatenate")
    names = list(dict.fromkeys(c for t in tables for c in user_columns(t)))
    distinct_names(names)
    kinds = {n: common_type([type_name(t.schema[n].dataType) for t in tables if n in t.columns]) for n in names}
    parts = [t.select(*[(as_type(t, n, kinds[n]) if n in t.columns else F.lit(None).cast(spark_type(kinds[n]))).alias(n) for n in names]) for t in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def stack(df: DataFrame, columns: list[str], ids: list[str], number_rows: bool = False) -> DataFrame:
    """Long form: ids, ``Label`` (the column name) and ``Value``, nulls kept; ids in column blocks on request."""
    if not columns:
        raise ValueError("no columns to stack")
    require(df, *columns, *ids)
    distinct_names([*ids, "Label", "Value"])
    kind = common_type([type_name(df.schema[c].dataType) for c in columns])
    if not number_rows and not set(columns) & set(ids):
        wide = df.select(*map(col, ids), *[as_type(df, c, kind).alias(c) for c in columns])
        return wide.unpivot([col(c) for c in ids], [col(c) for c in columns], "Label", "Value")
    cells = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(c).alias("Label"), as_type(df, c, kind).alias("Value")) for i, c in enumerate(columns)])
    before = [col(ROW_ID)] if ROW_ID in df.columns else []
    long = df.select(*map(col, ids), *[c.alias("__at") for c in before], F.explode(cells).alias("__cell"))
    flat = long.select(*map(col, ids), *(["__at"] if before else []), "__cell.p", "__cell.Label", "__cell.Value")
    if not number_rows:
        return flat.select(*map(col, ids), "Label", "Value")
    return assign_row_id(flat, F.col("p"), *([F.col("__at")] if before else [])).drop("p", "__at")


def split(df: DataFrame, split_column: str, value_column: str, ids: list[str] | None = None) -> DataFrame:
    """Wide form: a column per distinct text of ``split_column``; repeats get rows of their own.

    Reads the distinct labels first (at most ``spark.sql.pivotMaxValues``).
    Repeats within (ids, label) are told apart by ``_row_id``, or by value
    where there is none.
    """
    ids = list(ids) if ids is not None else [c for c in user_columns(df) if c not in (split_column, value_column)]
    require(df, split_column, value_column, *ids)
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    text = col(split_column).cast("string")
    labels = sorted(r[0] for r in df.select(text).where(text.isNotNull()).distinct().limit(most + 1).collect())
    if not labels:
        raise ValueError(f"{split_column} has no value to split by")
    if len(labels) > most:
        raise ValueError(f"{split_column} has more than {most} values")
    distinct_names([*ids, *labels])
    order = [col(ROW_ID)] if ROW_ID in df.columns else [col(value_column).asc_nulls_last()]
    rank = F.row_number().over(W.partitionBy(*map(col, [*ids, split_column])).orderBy(*order))
    cells = df.select(*map(col, ids), text.alias("__label"), col(value_column).alias("__value"), rank.alias("__n"))
    wide = cells.groupBy(*map(col, ids), "__n").pivot("__label", labels).agg(F.max("__value"))
    return wide.select(*map(col, ids), *map(col, labels))


#: Rows that are turned together, and columns of a group of the result.
TILE = 1000


def transpose_tiles(df: DataFrame, tile: int = TILE) -> DataFrame:
    """``position, Label, block, cells``: for each column of ``df`` and each block of ``tile`` rows the texts of its cells.

    Rows go to their block by place, a block is turned by the task that has it,
    and no task holds more than a block of rows.
    """
    names = user_columns(df)
    if not names:
        raise ValueError("no columns to transpose")
    placed = assign_row_id(df.withColumnRenamed(ROW_ID, "__old"), F.col("__old").asc()) if ROW_ID in df.columns else assign_row_id(df)
    place = F.col(ROW_ID) - 1
    rows = placed.select(F.floor(place / tile).alias("block"), F.struct((place % tile).alias("slot"), *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    turned = rows.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("Label"), F.transform("rows", lambda r: r[f"c{i}"]).alias("cells")) for i, c in enumerate(names)]
    return turned.select("block", F.inline(F.array(*cells))).select("position", "Label", "block", "cells")


def transpose_group(tiles: DataFrame, block: int, rows: int, tile: int = TILE) -> DataFrame:
    """Of ``transpose_tiles`` one group of the result's columns: ``Label`` and ``RowI`` for the rows of a block; ``rows`` is the count of all."""
    first = block * tile
    return tiles.where(F.col("block") == block).orderBy("position").select("Label", *[F.get("cells", F.lit(i)).alias(f"Row{first + i + 1}") for i in range(min(tile, rows - first))])


def transpose(df: DataFrame) -> DataFrame:
    """``Label`` and ``Row1..RowN``: a row per column of ``df``, a text column per row.

    For tables of more rows than a plan should have columns
    (``spark.sql.pivotMaxValues``) take ``transpose_tiles`` and its groups of columns.
    """
    rows = df.count()
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if rows > most:
        raise ValueError(f"more than {most} rows can't become columns of one table; use transpose_tiles and transpose_group")
    tiles = transpose_tiles(df)
    blocks = range(-(-rows // TILE)) or range(1)
    if not rows:
        names = df.sparkSession.createDataFrame(list(enumerate(user_columns(df))), "position int, Label string")
        return names.orderBy("position").select("Label")
    wide = tiles.groupBy("position", "Label").agg(*[F.first(F.when(F.col("block") == b, F.col("cells")), ignorenulls=True).alias(f"b{b}") for b in blocks])
    return wide.orderBy("position").select("Label", *[F.get(f"b{i // TILE}", F.lit(i % TILE)).alias(f"Row{i + 1}") for i in range(rows)])


def summary(df: DataFrame, stat_columns: list[str], group_columns: list[str] = (), statistics: list[str] = tuple(STATISTICS)) -> DataFrame:
    """Group columns and ``<column>_<Statistic>`` for every pair; unknown statistics are ignored; null is a group."""
    require(df, *stat_columns, *group_columns)
    chosen = [s for s in statistics if s in STATISTICS]
    for c in stat_columns:
        if set(chosen) & {"mean", "std", "sum", "median"} and not is_numeric(df.schema[c].dataType):
            raise ValueError(f"{c} is not numeric")
    named = [(c, s, f"{c}_{STATISTICS[s][0]}") for c in stat_columns for s in chosen]
    if not named and not group_columns:
        raise ValueError("nothing to summarise")
    distinct_names([*group_columns, *(n for _, _, n in named)])
    if not named:
        return df.select(*map(col, group_columns)).distinct()
    keys = [f"g{i}" for i in range(len(group_columns))]
    keyed = df.select(*[col(c).alias(k) for c, k in zip(group_columns, keys)], *[col(c).alias(f"c{i}") for i, c in enumerate(stat_columns)])
    own = {c: f"c{i}" for i, c in enumerate(stat_columns)}
    if "median" in chosen and all(isinstance(df.schema[c].dataType, (T.IntegralType, T.DoubleType, T.FloatType)) for c in stat_columns):
        return _summary_of_runs(keyed, keys, group_columns, own, named, df.schema)
    exprs = [STATISTICS[s][1](F.col(own[c])).alias(f"s{i}") for i, (c, s, _) in enumerate(named) if s != "median"] or [F.count(F.lit(1)).alias("rows")]
    out = keyed.groupBy(*keys).agg(*exprs)
    if "median" in chosen:
        cells = F.array(*[F.struct(F.lit(i).alias("p"), F.col(own[c]).cast("double").alias("v")) for i, (c, s, _) in enumerate(named) if s == "median"])
        halves = rank_quantiles(keyed.select(*keys, F.inline(cells)), [*keys, "p"], [0.5])
        wide = halves.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(*[F.max(F.when(F.col("p") == i, F.get("q", F.lit(0)))).alias(f"s{i}") for i, (_, s, _) in enumerate(named) if s == "median"])
        # Without groups both sides have one row; a constant joins them.
        out = out.join(wide, reduce(and_, [out[k].eqNullSafe(wide[f"m_{k}"]) for k in keys]), "left") if keys else out.withColumn("k", F.lit(0)).join(wide.withColumn("k", F.lit(0)), "k", "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(group_columns, keys)], *[F.col(f"s{i}").alias(n) for i, (_, _, n) in enumerate(named)])


def _summary_of_runs(keyed: DataFrame, keys: list[str], group_columns: list[str], own: dict[str, str], named: list[tuple[str, str, str]], schema: T.StructType) -> DataFrame:
    """A summary with medians of whole numbers and doubles: one pass that counts runs of equal values, all statistics from these."""
    columns = list(own)
    whole = lambda c: isinstance(schema[c].dataType, T.IntegralType)
    cells = [F.struct(F.lit(i).alias("p"), F.col(own[c]).cast("double").alias("v"), (F.col(own[c]).cast("long") if whole(c) else F.lit(None).cast("long")).alias("w")) for i, c in enumerate(columns)]
    found = statistics(runs_of(keyed.select(*keys, F.inline(F.array(*cells))), [*keys, "p"]), [*keys, "p"], [0.5])

    def value(c: str, s: str) -> Column:
        bound = {"min": "low", "max": "high"}.get(s)
        column = F.col(f"{bound}_w" if bound and whole(c) else bound or {"n": "n", "mean": "mean", "std": "std", "sum": "sum"}.get(s, "n"))
        column = F.get("q", F.lit(0)) if s == "median" else column.cast(schema[c].dataType) if bound else column
        out = F.max(F.when(F.col("p") == columns.index(c), column))
        return F.coalesce(out, F.lit(0).cast("long")) if s == "n" else out

    wide = found.groupBy(*keys).agg(*[value(c, s).alias(f"s{i}") for i, (c, s, _) in enumerate(named)])
    return wide.select(*[F.col(k).alias(c) for c, k in zip(group_columns, keys)], *[F.col(f"s{i}").alias(n) for i, (_, _, n) in enumerate(named)])


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join that keeps both keys; right names that clash get ``_r``; an unknown kind is inner."""
    require(left, left_key), require(right, right_key)
    how = how.lower() if how.lower() in ("inner", "left", "right", "full") else "inner"
    ours, theirs = user_columns(left), user_columns(right)
    taken = {c.lower() for c in ours}
    new = [f"{c}_r" if c.lower() in taken else c for c in theirs]
    distinct_names([*ours, *new])
    a = left.select(*[col(c).alias(f"l{i}") for i, c in enumerate(ours)])
    b = right.select(*[col(c).alias(f"r{i}") for i, c in enumerate(theirs)])
    return a.join(b, a[f"l{ours.index(left_key)}"] == b[f"r{theirs.index(right_key)}"], how).toDF(*ours, *new)


def update(left: DataFrame, right: DataFrame, match: str, columns: list[str]) -> DataFrame:
    """Columns of ``left`` overwritten by those of the matching row of ``right``, nulls included.

    Of several right rows the one with the highest ``_row_id`` wins (with the
    greatest values, where there are no ids).
    """
    require(left, match, *columns), require(right, match, *columns)
    order = [col(ROW_ID)] if ROW_ID in right.columns else [col(c) for c in columns]
    best = right.where(col(match).isNotNull()).groupBy(col(match).alias("__key")).agg(F.max_by(F.struct(*map(col, columns)), F.struct(*order)).alias("__new"))
    out = left.join(best, col(match) == F.col("__key"), "left")
    return out.select(*[F.when(F.col("__key").isNotNull(), F.col("__new").getField(c).cast(left.schema[c].dataType)).otherwise(col(c)).alias(c) if c in columns else col(c) for c in left.columns])
