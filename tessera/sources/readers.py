"""Sources: CSV, TSV blocks, project files, empty tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.names import ROW_ID, col, distinct_names, quoted
from ..functions.storage import durable
from ..functions.textkinds import as_kind, kind_of, kinds_in
from ..functions.types import convert, spark_type
from ..operators.rowid import assign_row_id
from .dialect import Dialect, detect_dialect


def in_file_order(df: DataFrame) -> DataFrame:
    """Row ids in the order of the lines of the files that ``df`` reads."""
    kept = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    return assign_row_id(kept, F.col("__f"), F.col("__b"), F.col("__i")).drop("__f", "__b", "__i")


#: Splits of files (a path and a few numbers each) that are broadcast; more are joined by shuffle.
MOST_BROADCAST_SPLITS = 50_000


def _csv_options(delimiter: str, quote: str) -> dict[str, str]:
    # A null value that no file holds tells an empty cell (null) from a quoted empty text.
    return {"sep": delimiter, "quote": quote, "escape": quote, "nullValue": "\u0001", "emptyValue": ""}


def _with_breaks(lines: DataFrame) -> DataFrame:
    """Records of files in which quoted cells hold line breaks: ``file, block, id, value``, with ``id`` the number of the record in its file.

    A line begins a record if the quotes before it, in its split and the splits
    before, are even; so each split can tell by itself once the quotes of all
    splits are counted, and the lines of a record meet by its number.  A file
    with an odd number of quotes in all is taken line by line.
    """
    totals = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"))
    in_file = W.partitionBy("file").orderBy("block")
    totals = totals.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.sum("q").over(in_file) - F.col("q")).alias("before"), (F.sum("q").over(W.partitionBy("file")) % 2 == 1).alias("odd"))
    in_split = W.partitionBy("file", "block").orderBy("id")
    ahead = F.sum("quotes").over(in_split) - F.col("quotes")
    marked = lines.withColumn("ahead", ahead).join(totals, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    begins = F.col("odd") | ((F.col("before") + F.col("ahead")) % 2 == 0)
    marked = marked.select("file", "block", "id", "value", begins.cast("long").alias("begins"))
    starts = marked.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    starts = starts.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.sum("n").over(in_file) - F.col("n")).alias("before"))
    numbered = marked.withColumn("own", F.sum("begins").over(in_split)).join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    joined = numbered.groupBy("file", (F.col("before") + F.col("own")).alias("id")).agg(F.sort_array(F.collect_list(F.struct("block", F.col("id").alias("i"), "value"))).alias("lines"))
    return joined.select("file", F.lit(0).cast("long").alias("block"), "id", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))


def read_csv(spark: SparkSession, path: str, header: bool | None = None, schema: T.StructType | None = None, delimiter: str | None = None, quote: str | None = None, **options) -> DataFrame:
    """A CSV file or folder with inferred (or given) types and row ids in file order.

    Delimiter, quote and header are told from a sample of the first lines unless
    given; names that repeat get a number, a file without names has ``column0``
    and so on.  The lines are read once, split, and stored with their place; the
    types are those that all cells of a column fit (see ``textkinds``: whole
    numbers are BIGINT, a time of day stays text).  Row ids come from a count per
    split of a file, without a sort.  Quoted cells may hold line breaks (which
    come out as line feeds); their files are read in splits, too.  Blank lines are
    passed over, missing cells are null, cells beyond the columns are ignored.
    """
    given = delimiter is not None and quote is not None and header is not None and schema is not None
    how = Dialect(delimiter, quote, header) if given else detect_dialect(spark, path, header, delimiter or options.pop("sep", None), quote)
    kept = _csv_options(how.delimiter, how.quote) | {k: str(v) for k, v in options.items()}
    names = list(schema.names if schema else how.names)
    if not names:
        return assign_row_id(spark.createDataFrame([], T.StructType([])))
    distinct_names(names)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(how.quote), F.lit("")))
    clean = F.when((F.col("_metadata.file_block_start") == 0) & F.col("value").startswith("\ufeff"), F.substring("value", F.lit(2), F.lit(2**31 - 1))).otherwise(F.col("value"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), clean.alias("value"), quotes.cast("long").alias("quotes")
    )
    kinds = schema or T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = F.from_csv("value", _ddl(kinds), kept)
    filled = lines.where(F.trim("value") != "")
    stored = durable(filled.select("file", "block", "id", (F.col("quotes") % 2 == 1).alias("broken"), cells.alias("cells")), "csv")
    if not stored.where("broken").isEmpty():
        records = _with_breaks(lines).where(F.trim("value") != "")
        stored = durable(records.select("file", "block", "id", cells.alias("cells")), "csv")
    rows = _placed(stored, how.header)
    if schema:
        return rows.select(ROW_ID, *[F.col(f"cells.{quoted(f.name)}").cast(f.dataType).alias(f.name) for f in schema.fields])
    texts = [F.col(f"cells.c{i}") for i in range(len(names))]
    met = kinds_in(rows, texts)
    return rows.select(ROW_ID, *[as_kind(t, *kind_of(k)).alias(n) for t, k, n in zip(texts, met, names)])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def _placed(stored: DataFrame, header: bool) -> DataFrame:
    """``stored`` with row ids in the order of files and lines, without the first line of each file if that is a header.

    The place of a line in its split of a file comes from its id and the least
    id there (ranked, if blank lines left gaps); one row per split is ordered to
    number the splits.
    """
    splits = durable(stored.groupBy("file", "block").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")), "splits")
    gaps, n = splits.agg(F.count_if(F.col("most") - F.col("least") + 1 != F.col("n")), F.count(F.lit(1))).first()
    first = F.row_number().over(W.partitionBy("file").orderBy("block")) == 1
    splits = splits.select("*", (first & F.lit(header)).cast("long").alias("head"))
    base = F.sum(F.col("n") - F.col("head")).over(W.orderBy("file", "block")) - (F.col("n") - F.col("head"))
    splits = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), "head", "least", base.alias("base"))
    side = F.broadcast(splits) if n <= MOST_BROADCAST_SPLITS else splits
    both = stored.join(side, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("id")) if gaps else F.col("id") - F.col("least") + 1
    both = both.withColumn("place", place).where("place > head")
    return both.select((F.col("base") + F.col("place") - F.col("head")).cast("long").alias(ROW_ID), "cells")


def read_tsv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """A block of tab-separated lines without quoting; as wide as its widest line, short lines padded with nulls."""
    lines = in_file_order(spark.read.option("wholetext", False).text(path)).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    cells = lines.select(ROW_ID, F.split("value", "\t").alias("c"))
    size = cells.agg(F.max(F.size("c")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    width = size.w or 0
    names = [f"c{i + 1}" for i in range(width)]
    if header and size.n > 1:
        first = cells.where(F.col(ROW_ID) == 1).first().c
        names = [(first[i] if i < len(first) and first[i] else names[i]) for i in range(width)]
        cells = cells.where(F.col(ROW_ID) > 1).withColumn(ROW_ID, F.col(ROW_ID) - 1)
    distinct_names(names)
    return cells.select(ROW_ID, *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def create_table(spark: SparkSession, names: list[str], types: list[str]) -> DataFrame:
    """An empty table."""
    if len(names) != len(types):
        raise ValueError("as many types as names are needed")
    distinct_names(names)
    return spark.createDataFrame([], T.StructType([T.StructField(ROW_ID, T.LongType()), *(T.StructField(n, spark_type(t)) for n, t in zip(names, types))]))


_SET = "struct<id: string, name: string, sourceType: string, columns: array<struct<name: string, colType: string>>, rows: array<array<string>>>"
_PROJECT = f"name string, version string, createdAt string, datasets array<{_SET}>, snapshots array<struct<id: string, name: string, timestamp: string, snapshot: struct<datasets: array<{_SET}>>, datasets: array<{_SET}>>>"


@dataclass(frozen=True)
class ProjectFile:
    """What a project file holds: ``(id, name, table)`` of its datasets, and of those of each snapshot."""

    datasets: list[tuple[str, str, DataFrame]]
    snapshots: dict[str, list[tuple[str, str, DataFrame]]]


def read_project_file(spark: SparkSession, path: str) -> ProjectFile:
    """All datasets of a project file, with those of its snapshots.

    The file is read once, by one task, since it is one JSON value; its rows are
    stored, one each, and every table comes from there.
    """
    whole = spark.read.schema(_PROJECT).option("multiLine", True).json(path)
    own = whole.select(F.lit(None).cast("string").alias("snapshot"), F.lit(-1).alias("s"), F.posexplode("datasets").alias("d", "set"))
    held = whole.select(F.posexplode("snapshots").alias("s", "x")).select(F.coalesce("x.name", F.col("x.id")).alias("snapshot"), "s", F.posexplode(F.coalesce("x.snapshot.datasets", "x.datasets")).alias("d", "set"))
    sets = own.unionByName(held)
    head = ["snapshot", "s", "d", F.col("set.id").alias("id"), F.col("set.name").alias("name"), F.col("set.columns").alias("columns")]
    stored = durable(sets.select(*head, F.posexplode_outer("set.rows").alias("place", "row")), "project")
    metas = stored.where("coalesce(place, 0) = 0").select("snapshot", "s", "d", "id", "name", "columns").distinct().orderBy("s", "d").collect()
    text = spark_type("VARCHAR")

    def table(m) -> tuple[str, str, DataFrame]:
        cells = [convert(F.get("row", F.lit(i + 1)), text, c.colType).cast(spark_type(c.colType)).alias(c.name) for i, c in enumerate(m["columns"] or [])]
        rows = stored.where((F.col("s") == m.s) & (F.col("d") == m.d) & F.col("row").isNotNull())
        return m.id, m.name, rows.select(F.get("row", F.lit(0)).cast("long").alias(ROW_ID), *cells)

    out = ProjectFile([], {})
    for m in metas:
        (out.datasets if m.s < 0 else out.snapshots.setdefault(m.snapshot, [])).append(table(m))
    return out


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The datasets of a project file, by name; where a name repeats, the later ones have their id behind it."""
    out: dict[str, DataFrame] = {}
    for key, name, df in read_project_file(spark, path).datasets:
        out[name if name not in out else f"{name} ({key})"] = df
    return out


def get_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types in order, without the row id."""
    from ..functions.types import type_name

    return [(f.name, type_name(f.dataType)) for f in df.schema.fields if f.name != ROW_ID]


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    return assign_row_id(df, *[col(k).asc_nulls_last() for k in keys])
