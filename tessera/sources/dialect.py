"""How a CSV file is written: its delimiter, quote and header, from a bounded sample of its first lines."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.textkinds import kind_of, kinds_in

#: Tried in this order; the first of equal ones wins.
DELIMITERS = (",", "|", ";", "\t")
QUOTES = ('"', "'")
#: Lines looked at, and the longest line among them (others are left out of the sample, not of the file).
SAMPLE_LINES, SAMPLE_WIDTH = 2000, 1 << 14


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    names: tuple[str, ...] = ()


def sample_lines(spark: SparkSession, path: str) -> list[str]:
    """The first lines of one of the files, as far as they are not too long."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = lines.where("b = 0 and trim(value) <> ''")
    first = lines.select("f").first()
    if first is None:
        return []
    own = lines.where(F.col("f") == first.f)
    found = [r.value for r in own.where(F.length("value") <= SAMPLE_WIDTH).select("value").limit(SAMPLE_LINES).collect()]
    return found or [own.select("value").first().value]


def _cells(lines: list[str], delimiter: str, quote: str) -> list[list[str]] | None:
    """The rows of a sample, or None if its quoting is broken; a quoted cell that the sample cuts off ends it."""
    how = {"quotechar": quote, "doublequote": True, "strict": True} if quote else {"quoting": csv.QUOTE_NONE}
    rows: list[list[str]] = []
    try:
        for row in csv.reader((f"{x}\n" for x in lines), delimiter=delimiter, **how):
            rows.append(row)
    except csv.Error as e:
        if "end of data" not in str(e) or len(lines) < SAMPLE_LINES:
            return None
    return [r for r in rows if r]


def guess(lines: list[str]) -> tuple[str, str, list[list[str]]]:
    """Delimiter, quote and rows of the reading that splits a sample most evenly.

    A quote counts if it surrounds whole cells.  Of the readings in which at
    least half of the rows have the commonest width, that with the most even
    rows wins, then the wider one, then the earlier delimiter.
    """
    best: tuple[tuple, str, str, list[list[str]]] | None = None
    for place, d in enumerate(DELIMITERS):
        plain = _cells(lines, d, "") or []
        quote, rows = "", plain
        for q in QUOTES:
            read = _cells(lines, d, q)
            if read and read != plain:
                quote, rows = q, read
                break
        if not rows:
            continue
        width, n = Counter(map(len, rows)).most_common(1)[0]
        if width == 1 and place or n * 2 < len(rows):
            continue
        score = (width > 1, n == len(rows), n / len(rows), width, -place)
        if best is None or score > best[0]:
            best = (score, d, quote or '"', rows)
    return best[1:] if best else (",", '"', [[x] for x in lines])


def unique_names(names: list[str]) -> tuple[str, ...]:
    """Names of columns: blank ones by their place, repeated ones (whatever the case) with a number."""
    out: list[str] = []
    taken: set[str] = set()
    for i, name in enumerate(names):
        name = name.strip() or f"column{i}"
        new, k = name, 0
        while new.lower() in taken:
            k += 1
            new = f"{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return tuple(out)


def _names_columns(spark: SparkSession, rows: list[list[str]], width: int) -> bool:
    """Whether the first row names the columns: all columns are text, or it doesn't fit the kinds of the rows below."""
    if len(rows) == 1:
        kinds = _kinds(spark, rows, width)
        return all(k == "VARCHAR" for k in kinds)
    below, own = _kinds(spark, rows[1:], width), _kinds(spark, rows[:1], width)
    if all(k == "VARCHAR" for k in below):
        return True
    first = rows[0] + [""] * width
    return any(k not in ("VARCHAR", "") and v.strip() and o != k and not (k == "DOUBLE" and o == "BIGINT") and not (k == "TIMESTAMP" and o == "DATE") for k, o, v in zip(below, own, first))


def _kinds(spark: SparkSession, rows: list[list[str]], width: int) -> list[str]:
    """The kind of each column of a sample, which goes to Spark as one table."""
    cells = [tuple((r + [None] * width)[:width]) for r in rows]
    df = spark.createDataFrame(cells, ", ".join(f"c{i} string" for i in range(width)))
    return kinds_of_columns(df)


def kinds_of_columns(df: DataFrame) -> list[str]:
    """The kinds of text columns, in one aggregation."""
    return [kind_of(k)[0] for k in kinds_in(df, [col(c) for c in df.columns])]


def detect_dialect(spark: SparkSession, path: str, header: bool | None = None, delimiter: str | None = None, quote: str | None = None) -> Dialect:
    """The dialect of a CSV file or folder; what is given is not guessed."""
    lines = sample_lines(spark, path)
    if not lines:
        return Dialect(delimiter or ",", quote or '"', True if header is None else header)
    lines[0] = lines[0].removeprefix("﻿")
    if delimiter is None:
        delimiter, found, rows = guess(lines)
        quote = quote or found
    else:
        quote = quote or '"'
        rows = _cells(lines, delimiter, quote) or _cells(lines, delimiter, "") or [[""]]
    width = Counter(map(len, rows)).most_common(1)[0][0]
    width = max(width, len(rows[0]))
    header = _names_columns(spark, rows, width) if header is None else header
    first = (rows[0] + [""] * width)[:width] if header else [""] * width
    return Dialect(delimiter, quote, header, unique_names(first))
