"""SQLite files as a Spark data source, read by row id range and written in one commit."""

from __future__ import annotations

import heapq
import os
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.names import ROW_ID, col, user_columns
from ..functions.types import convert, spark_type
from ..operators.rowid import assign_row_id
from .writers import file_name

SPLIT_ROWS, MOST_SPLITS = 100_000, 10_000


def mapped_type(declared: str) -> str:
    """BIGINT, DOUBLE or VARCHAR by what the declared type contains, in this order."""
    name = (declared or "").upper()
    if any(x in name for x in ("INT", "BOOL")):
        return "BIGINT"
    if any(x in name for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "DOUBLE"
    return "VARCHAR"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """User tables and their columns with mapped types; tables without columns are left out."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        found = {n: [(c[1], mapped_type(c[2])) for c in db.execute(f"PRAGMA table_info({_quoted(n)})")] for n in names}
    return {n: c for n, c in found.items() if c}


def _together(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Neighbouring ranges joined while their ids are so few that they can't have more than ``SPLIT_ROWS`` rows."""
    held: tuple[int, int] | None = None
    for low, high in ranges:
        if held and high - held[0] < SPLIT_ROWS:
            held = (held[0], high)
            continue
        if held:
            yield held
        held = (low, high)
    if held:
        yield held


@dataclass
class _Range(InputPartition):
    low: int | None
    high: int | None


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.table, self.names = options["path"], options["dbtable"], schema.names[1:]

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids with about as many rows each, wherever the ids lie.

        A range is drawn in to the ids that it really has, then halved while it
        has more than ``SPLIT_ROWS`` rows, the widest first, up to ``MOST_SPLITS``
        ranges.  Counting a range stops after ``SPLIT_ROWS`` rows.
        """
        name = _quoted(self.table)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                db.execute(f"SELECT rowid FROM {name} LIMIT 1")
            except sqlite3.OperationalError:  # WITHOUT ROWID
                return [_Range(None, None)]

            def drawn_in(low: int, high: int) -> tuple[int, int] | None:
                one = lambda of, order: db.execute(f"SELECT {of}(rowid) FROM {name} WHERE rowid BETWEEN ? AND ?", order).fetchone()[0]
                first = one("min", (low, high))
                return None if first is None else (first, one("max", (low, high)))

            def full(low: int, high: int) -> bool:
                if high - low < SPLIT_ROWS:
                    return False
                return db.execute(f"SELECT rowid FROM {name} WHERE rowid BETWEEN ? AND ? ORDER BY rowid LIMIT 1 OFFSET ?", (low, high, SPLIT_ROWS)).fetchone() is not None

            every = drawn_in(-(2**63), 2**63 - 1)
            done: list[tuple[int, int]] = []
            wide = [(every[0] - every[1], *every)] if every and full(*every) else []
            done += [every] if every and not wide else []
            while wide and len(done) + len(wide) < MOST_SPLITS:
                _, low, high = heapq.heappop(wide)
                middle = low + (high - low) // 2
                for part in (drawn_in(low, middle), drawn_in(middle + 1, high)):
                    if part and full(*part):
                        heapq.heappush(wide, (part[0] - part[1], *part))
                    elif part:
                        done.append(part)
        ranges = sorted(done + [(low, high) for _, low, high in wide])
        return [_Range(low, high) for low, high in _together(ranges)] or [_Range(0, -1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        def text(value):
            if value is None or isinstance(value, bytes):
                return None
            return repr(value) if isinstance(value, float) else str(value)

        names = ", ".join(map(_quoted, self.names))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            if partition.low is None:
                rows = db.execute(f"SELECT 0, {names} FROM {_quoted(self.table)}")
                yield from ((i, *map(text, r[1:])) for i, r in enumerate(rows))
            else:
                rows = db.execute(f"SELECT rowid, {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
                yield from ((r[0], *map(text, r[1:])) for r in rows)


@dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int


_KINDS = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.BooleanType: "BOOLEAN", T.DoubleType: "DOUBLE", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP"}
_BATCH = 10_000


class _Writer(DataSourceWriter):
    """Every task writes a database of its own beside the target.

    The commit of a folder gives them their names.  That of a single file copies
    them into it table by table, within SQLite, in one transaction each.
    """

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        self.shards = options.get("shards", "false").lower() == "true"

    def _create(self, db: sqlite3.Connection) -> None:
        fields = ", ".join(f"{_quoted(f.name)} {_KINDS.get(type(f.dataType), 'TEXT')}" for f in self.schema.fields)
        db.execute(f"CREATE TABLE {_quoted(self.table)} ({fields})")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = self.path if self.shards else os.path.dirname(self.path) or "."
        os.makedirs(folder, exist_ok=True)
        handle, name = tempfile.mkstemp(prefix=".part-", dir=folder)
        os.close(handle)
        marks, n = ", ".join("?" * len(self.schema.fields)), 0
        plain = (tuple(v if isinstance(v, (int, float, str, type(None))) else str(v) for v in row) for row in rows)
        with closing(sqlite3.connect(name)) as db, db:
            db.execute("PRAGMA journal_mode = OFF")
            self._create(db)
            while batch := list(islice(plain, _BATCH)):
                db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({marks})", batch)
                n += len(batch)
        return _Part(name, n)

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m]
        if self.shards:
            for i, m in enumerate(parts):
                os.replace(m.file, f"{self.path}/{file_name(self.table)}-{i:05d}.db")
            return
        with closing(sqlite3.connect(self.path)) as db:
            with db:
                db.execute(f"DROP TABLE IF EXISTS {_quoted(self.table)}")
                self._create(db)
            for m in parts:
                db.execute("ATTACH DATABASE ? AS part", (m.file,))
                with db:
                    db.execute(f"INSERT INTO {_quoted(self.table)} SELECT * FROM part.{_quoted(self.table)} ORDER BY rowid")
                db.execute("DETACH DATABASE part")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.file and os.path.exists(m.file):
                os.unlink(m.file)


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite_file")``: options ``path`` and ``dbtable``; all columns as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        columns = tables(self.options["path"])[self.options["dbtable"]]
        return T.StructType([T.StructField("__rowid", T.LongType()), *(T.StructField(c, T.StringType()) for c, _ in columns)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options)


def read_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every user table of a SQLite file, typed; values that don't fit their type are null.

    Of a folder, the tables of all its ``.db`` files; those of one name are one
    table (with the columns that the first of its files has), in the order of the files.
    """
    spark.dataSource.register(SQLiteSource)
    files = sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".db")) if os.path.isdir(path) else [path]
    found: dict[str, tuple[list[tuple[str, str]], list[DataFrame]]] = {}
    for at, file in enumerate(files):
        for name, columns in tables(file).items():
            columns, reads = found.setdefault(name, (columns, []))
            raw = spark.read.format("sqlite_file").option("path", file).option("dbtable", name).load()
            reads.append(raw.select(F.lit(at).alias("__file"), "__rowid", *[col(c) for c, _ in columns]))
    out, text = {}, spark_type("VARCHAR")
    for name, (columns, reads) in found.items():
        whole = reduce(DataFrame.unionAll, reads)
        typed = whole.select("__file", "__rowid", *[convert(col(c), text, k).alias(c) if k != "VARCHAR" else col(c) for c, k in columns])
        out[name] = assign_row_id(typed, F.col("__file"), F.col("__rowid")).drop("__file", "__rowid")
    return out


def export_sqlite(tables_by_name: dict[str, DataFrame], path: str, shards: bool = False) -> None:
    """Each dataset as a table of its name, user columns only.

    ``path`` is a file, or with ``shards`` a folder that gets a file per dataset
    and partition: then rows pass no other process than the tasks'.
    """
    for name, df in tables_by_name.items():
        df.sparkSession.dataSource.register(SQLiteSource)
        out = df.select(*map(col, user_columns(df))).write.format("sqlite_file").option("path", path).option("dbtable", name)
        out.option("shards", str(shards).lower()).mode("append").save()


__all__ = ["ROW_ID", "SQLiteSource", "export_sqlite", "mapped_type", "read_sqlite", "tables"]
