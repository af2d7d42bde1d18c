"""Rows by place: a sorted copy of a table with the places of each stored part, so that a page opens only the parts it lies in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, col
from ..functions.storage import durable

_FILE, _PLACE = "__file", "__place"
#: Parts whose rows are read by a filter for each; more are joined with their first places.
_FEW_PARTS = 64


@dataclass(frozen=True)
class Part:
    """A stored file: its path, what its stored places lack, the place of its first row, and its rows."""

    path: str
    base: int
    first: int
    rows: int


@dataclass(frozen=True)
class Ordered:
    """A sorted copy of a table.  Places count from 1, whatever ids the rows have."""

    stored: DataFrame
    parts: list[Part]
    columns: list[str]

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)

    def between(self, first: int, last: int, place: str = _PLACE) -> DataFrame:
        """The rows from place ``first`` to ``last``, with their place; other parts are not opened."""
        held = [p for p in self.parts if p.first <= last and p.first + p.rows > first]
        spark = self.stored.sparkSession
        names = [col(c) for c in self.columns]
        if not held:
            return self.stored.where("false").select(F.col(_PLACE).alias(place), *names)
        if len(held) <= _FEW_PARTS:
            reads = [spark.read.schema(self.stored.schema).parquet(p.path).where(F.col(_PLACE).between(first - p.base, last - p.base)).select((F.col(_PLACE) + p.base).alias(place), *names) for p in held]
            out = reads[0]
            for x in reads[1:]:
                out = out.unionAll(x)
            return out
        base = spark.createDataFrame([(p.path, p.base) for p in held], f"{_FILE} string, __base long")
        read = spark.read.schema(self.stored.schema).parquet(*[p.path for p in held]).withColumn("__own", F.col("_metadata.file_path"))
        both = read.join(base, F.col("__own") == F.col(_FILE))
        return both.select((F.col(_PLACE) + F.col("__base")).alias(place), *names).where(F.col(place).between(first, last))

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows, in order."""
        found = self.between(number * size + 1, (number + 1) * size)
        return found.coalesce(1).sortWithinPartitions(_PLACE).select(*map(col, self.columns))

    def block(self, row_a: int, row_b: int, column_a: int, column_b: int) -> DataFrame:
        """The rectangle between two corners (places of rows and user columns, from 1, inclusive, in any order)."""
        (top, bottom), (left, right) = sorted((row_a, row_b)), sorted((column_a, column_b))
        names = [c for c in self.columns if c != ROW_ID][left - 1 : right]
        return self.between(top, bottom).select(*map(col, names))


def ordered(df: DataFrame, *order: Column) -> Ordered:
    """``df`` sorted and stored once (as it comes, without an order); the driver sees a path and a count per part."""
    ranked = df.orderBy(*order) if order else df
    place = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(_PLACE)
    part = F.shiftright(F.monotonically_increasing_id(), 33).alias("__part")
    stored = durable(ranked.select("*", part, place), "ordered")
    counts = stored.select("__part", _PLACE, F.col("_metadata.file_path").alias(_FILE)).groupBy(_FILE).agg(F.min("__part").alias("part"), F.min(_PLACE).alias("low"), F.count(F.lit(1)).alias("n")).collect()
    parts, base = [], 0
    for r in sorted(counts, key=lambda r: (r.part, r.low)):
        parts.append(Part(r[_FILE], base - (r.low - 1), base + 1, r.n))
        base += r.n
    return Ordered(stored, parts, df.columns)


def by_id(df: DataFrame) -> Ordered:
    """``df`` in the order of its row ids (as it comes, where it has none)."""
    return ordered(df, F.col(ROW_ID).asc()) if ROW_ID in df.columns else ordered(df)


def ids_are_places(df: DataFrame) -> bool:
    """Whether row ids run from 1 without gaps; one aggregation."""
    low, high, n = df.agg(F.min(ROW_ID), F.max(ROW_ID), F.count(F.lit(1))).first()
    return n == 0 or (low == 1 and high == n)

