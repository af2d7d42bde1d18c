"""Edits as set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, absent, col, require, user_columns
from ..functions.types import convert, spark_type, type_name
from .columns import default_name
from .rowid import assign_row_id


def _top_id(df: DataFrame) -> int:
    return df.agg(F.max(ROW_ID)).first()[0] or 0


def append_rows(df: DataFrame, count: int) -> DataFrame:
    """``count`` empty rows with ids after the largest."""
    top = _top_id(df)
    new = df.sparkSession.range(top + 1, top + count + 1).select(F.col("id").cast(df.schema[ROW_ID].dataType).alias(ROW_ID))
    return df.unionByName(new, allowMissingColumns=True)


def _judged(df: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with ``reason``: null where a value can be written, else why it is refused."""
    text = spark_type("VARCHAR")
    kinds = {c: type_name(df.schema[c].dataType) for c in user_columns(df)}
    fits = F.lit(False)
    for kind in set(kinds.values()):
        own = F.col("column").isin([c for c, k in kinds.items() if k == kind])
        fits = fits | (own & convert(F.col("value"), text, kind).isNotNull())
    known = F.col("column").isin(list(kinds))
    kind_of = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("column")) if kinds else F.lit(None)
    reason = F.when(~F.coalesce(known, F.lit(False)), "no such column").when(F.coalesce(F.col("value"), F.lit("")) == "", F.lit(None)).when(~fits, F.concat(F.lit("no "), kind_of))
    return edits.withColumn("reason", reason)


def rejected_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits that ``apply_cell_edits`` does not write, with ``reason``: no such row, no such column, or a value that is not of the column's type."""
    judged = _judged(df, edits)
    rows = df.select(col(ROW_ID).alias("__id"))
    bad = judged.where("reason is not null")
    lost = judged.where("reason is null").join(rows, F.col(ROW_ID) == F.col("__id"), "left_anti").withColumn("reason", F.lit("no such row"))
    return bad.unionByName(lost)


def apply_cell_edits(df: DataFrame, edits: DataFrame, all_or_nothing: bool = False) -> DataFrame:
    """``edits (_row_id, column, value[, seq])``: text values by cell; empty text clears; the last edit wins.

    The last is the one with the largest ``seq`` (or text, without ``seq``) among
    those whose value converts to the column's type; a cell keeps its value where
    none does.  Edits of unknown rows or columns change nothing.
    ``rejected_edits`` lists what is not written; with ``all_or_nothing`` a batch
    that has any is refused (eager check).
    """
    if all_or_nothing:
        wrong = rejected_edits(df, edits).limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"row {r[ROW_ID]}, {r.column}: {r.reason}" for r in wrong))
    order = F.col("seq") if "seq" in edits.columns else F.col("value")
    names = user_columns(df)
    good = _judged(df, edits).where("reason is null")
    last = good.groupBy(ROW_ID, "column").agg(F.max_by(F.struct("value"), F.struct(order, "value")).alias("cell"))
    wide = last.groupBy(F.col(ROW_ID).alias("__id")).agg(*[F.first(F.when(F.col("column") == c, F.col("cell")), ignorenulls=True).alias(f"__e{i}") for i, c in enumerate(names)])
    both = df.join(wide, df[ROW_ID] == wide["__id"], "left")
    new = lambda i: F.nullif(F.col(f"__e{i}.value"), F.lit(""))
    text = spark_type("VARCHAR")
    return both.select(df[ROW_ID], *[F.when(F.col(f"__e{i}").isNotNull(), convert(new(i), text, type_name(df.schema[c].dataType)).cast(df.schema[c].dataType)).otherwise(df[f"`{c.replace('`', '``')}`"]).alias(c) for i, c in enumerate(names)])


def delete_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in the first column of ``ids``; the others keep their ids."""
    gone = ids.select(ids[0].alias("__gone")).distinct()
    return df.join(gone, df[ROW_ID] == gone["__gone"], "left_anti")


def patch_block(df: DataFrame, patch: DataFrame, row: int, column: int, detected: list[str] | None = None, header: list[str] | None = None) -> DataFrame:
    """Write a text block at row ``row`` (by place in id order) and column ``column`` (both from 1).

    ``patch`` has ``_row_id`` (its row order) and text columns.  Missing target
    columns are created (header or default names, detected types); empty target
    columns take the detected type; a header renames existing targets.  Cells
    that are not empty overwrite; empty ones are skipped; rows past the end are
    appended with ids after the largest.
    """
    block = user_columns(patch)
    detected = detected or ["VARCHAR"] * len(block)
    names, out = user_columns(df), df
    targets = names[column - 1 : column - 1 + len(block)]
    if targets:
        filled = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(targets)]).first()
        for i, c in enumerate(targets):
            if not filled[i] and type_name(df.schema[c].dataType) != detected[i]:
                out = out.withColumn(c, F.lit(None).cast(spark_type(detected[i])))
    for i, c in enumerate(list(targets)):
        if header and header[i] and header[i] != c:
            absent(out.drop(col(c)), header[i])
            out = out.withColumnRenamed(c, header[i])
            targets[i] = header[i]
    for i in range(len(targets), len(block)):
        new = header[i] if header and header[i] else default_name(out)
        absent(out, new)
        out = out.withColumn(new, F.lit(None).cast(spark_type(detected[i])))
        targets.append(new)
    top = _top_id(df)
    placed = assign_row_id(out.withColumnRenamed(ROW_ID, "__id"), F.col("__id").asc(), name="__at")
    cells = assign_row_id(patch.withColumnRenamed(ROW_ID, "__p"), F.col("__p").asc(), name="__q").select((F.col("__q") + (row - 1)).alias("__q"), *[col(c).alias(f"__c{i}") for i, c in enumerate(block)])
    n = placed.count()
    both = placed.join(cells, placed["__at"] == cells["__q"], "full")
    row_id = F.coalesce("__id", F.col("__q") - n + top).cast(df.schema[ROW_ID].dataType)
    text = spark_type("VARCHAR")

    def cell(c: str):
        if c not in targets:
            return col(c)
        kind = out.schema[c].dataType
        new = convert(F.nullif(F.col(f"__c{targets.index(c)}"), F.lit("")), text, type_name(kind)).cast(kind)
        return F.coalesce(new, col(c)).alias(c)

    return both.select(row_id.alias(ROW_ID), *map(cell, user_columns(out)))


def check_patch(df: DataFrame, patch: DataFrame, row: int, column: int, detected: list[str]) -> DataFrame:
    """``(column_name, compatible, conflicts)`` for each existing target column.

    A column with data that is not VARCHAR takes only its own type (and INTEGER
    into DOUBLE); conflicts are its values within the rows of the block.
    """
    block = user_columns(patch)
    targets = user_columns(df)[column - 1 : column - 1 + len(block)]
    require(df, *targets)
    height = patch.count()
    placed = assign_row_id(df.withColumnRenamed(ROW_ID, "__id"), F.col("__id").asc(), name="__at")
    inside = F.col("__at").between(row, row + height - 1)
    one = placed.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(targets)], *[F.count(F.when(inside, col(c))).alias(f"k{i}") for i, c in enumerate(targets)])
    cells = []
    for i, c in enumerate(targets):
        kind = type_name(df.schema[c].dataType)
        fits = kind in ("VARCHAR", detected[i]) or (kind, detected[i]) == ("DOUBLE", "INTEGER")
        cells.append(F.struct(F.lit(c).alias("column_name"), (F.lit(fits) | (F.col(f"n{i}") == 0)).alias("compatible"), F.col(f"k{i}").alias("conflicts")))
    return one.select(F.inline(F.array(*cells)))
