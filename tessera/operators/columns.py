"""Column operations: add, drop, rename, retype, detect, validate, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import absent, col, require, user_columns
from ..functions.numbers import fixed_text, grid_number, scientific_text
from ..functions.types import convert, is_numeric, spark_type

#: The texts that count as Boolean.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")
#: Currency code -> symbol.
CURRENCIES = {"CNY": "¥", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "KRW": "₩", "HKD": "HK$", "TWD": "NT$"}

#: What the texts of a type look like.
INTEGER = r"^-?\d+$"
NUMBER = r"^([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)$"
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"


def default_name(df: DataFrame) -> str:
    """The first free name of the form 列N."""
    taken, n = set(df.columns), 1
    while f"列{n}" in taken:
        n += 1
    return f"列{n}"


def add_column(df: DataFrame, name: str | None = None, kind: str = "VARCHAR") -> DataFrame:
    name = name or default_name(df)
    absent(df, name)
    return df.withColumn(name, F.lit(None).cast(spark_type(kind)))


def add_columns(df: DataFrame, count: int, kind: str = "VARCHAR") -> DataFrame:
    for _ in range(count):
        df = add_column(df, None, kind)
    return df


def delete_column(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    if user_columns(df) == [name]:
        raise ValueError("the last column can't be deleted")
    return df.drop(col(name))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    absent(df.drop(col(old)), new)
    return df.withColumnRenamed(old, new)


def conversion_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """For each column, how many of its values would not convert; one pass."""
    require(df, *types)
    bad = [F.count_if(col(c).isNotNull() & convert(col(c), df.schema[c].dataType, t).isNull()).alias(f"b{i}") for i, (c, t) in enumerate(types.items())]
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("target"), F.col(f"b{i}").alias("failed")) for i, (c, t) in enumerate(types.items())]
    return df.agg(*bad).select(F.inline(F.array(*cells)))


def change_type(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns converted; refused, with counts, if a value of any of them would be lost (eager check)."""
    failed = conversion_failures(df, types).where("failed > 0").collect()
    if failed:
        raise ValueError("; ".join(f"{r.failed} values of {r.column_name} are no {r.target}" for r in failed))
    return df.select(*[convert(col(c), df.schema[c].dataType, types[c]).alias(c) if c in types else col(c) for c in df.columns])


def _is_date(text: Column) -> Column:
    parts = F.split(F.replace(text, F.lit("/"), F.lit("-")), "-")
    day = F.try_make_timestamp(F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int"), F.get(parts, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return text.rlike(DATE) & F.coalesce(day.isNotNull(), F.lit(False))


def detect_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, detected)`` from the non-blank texts of each column; one aggregation, no row per cell.

    The first that all values fit of INTEGER (BIGINT beyond its range), DOUBLE,
    BOOLEAN, DATE; else, or without values, VARCHAR.
    """
    columns = columns or user_columns(df)
    require(df, *columns)
    trimmed = df.select(*[F.nullif(F.trim(col(c).cast("string")), F.lit("")).alias(f"t{i}") for i, c in enumerate(columns)])
    tests = []
    for i in range(len(columns)):
        t = F.col(f"t{i}")
        # Costly parts run only on texts that the pattern before them lets pass.
        integer = t.rlike(INTEGER)
        small = F.when(integer, (F.length(t) < 10) | t.try_cast("int").isNotNull()).otherwise(False)
        number = F.when(integer, True).otherwise(t.rlike(NUMBER))
        date = F.when(t.rlike(DATE), _is_date(t)).otherwise(False)
        word = F.when(F.length(t) <= 5, F.lower(t).isin(*BOOLEAN_WORDS)).otherwise(False)
        seen = lambda c: F.bool_and(F.when(F.col(f"t{i}").isNotNull(), c))  # noqa: E731, B023
        tests += [F.count(t).alias(f"n{i}"), seen(integer).alias(f"i{i}"), seen(small).alias(f"s{i}"), seen(number).alias(f"d{i}"), seen(word).alias(f"b{i}"), seen(date).alias(f"dt{i}")]
    one = trimmed.agg(*tests)

    def kind(i: int) -> Column:
        is_a = lambda name: F.col(f"{name}{i}")
        return F.when(is_a("n") == 0, "VARCHAR").when(is_a("i") & is_a("s"), "INTEGER").when(is_a("i"), "BIGINT").when(is_a("d"), "DOUBLE").when(is_a("b"), "BOOLEAN").when(is_a("dt"), "DATE").otherwise("VARCHAR")

    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), kind(i).alias("detected")) for i, c in enumerate(columns)])))


def is_valid(text: Column, kind: str) -> Column:
    """Whether a text value fits a type; a blank one always does."""
    t = F.trim(text)
    rules = {
        "INTEGER": t.rlike(INTEGER), "DOUBLE": t.rlike(NUMBER), "BOOLEAN": F.lower(t).isin(*BOOLEAN_WORDS),
        "DATE": F.coalesce(convert(t, spark_type("VARCHAR"), "DATE").isNotNull(), F.lit(False)), "TIMESTAMP": F.coalesce(convert(t, spark_type("VARCHAR"), "TIMESTAMP").isNotNull(), F.lit(False)),
    }
    return F.coalesce(t == "", F.lit(True)) | rules.get(kind, F.lit(True))


def validate(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``(column_name, n_invalid, sample)`` per column; the sample is the least invalid text; one pass."""
    require(df, *types)
    texts = {c: col(c).cast("string") for c in types}
    wrong = {c: ~is_valid(texts[c], t) for c, t in types.items()}
    one = df.agg(*[F.count_if(wrong[c]).alias(f"n{i}") for i, c in enumerate(types)], *[F.min(F.when(wrong[c], texts[c])).alias(f"s{i}") for i, c in enumerate(types)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_invalid"), F.col(f"s{i}").alias("sample")) for i, c in enumerate(types)])))


def formatted(column: Column, kind: str = "asis", decimals: int | None = None, currency: str = "CNY", number: Column | None = None) -> Column:
    """The display text of a value, as a grid shows it: null is empty, what is no number passes through.

    A text is a number by the rules of the grid (a blank is 0, no type suffix);
    decimals are rounded from the exact binary value, ties away from zero; an
    unknown currency has no symbol.
    """
    text = F.coalesce(column.cast("string"), F.lit(""))
    x = number if number is not None else grid_number(column.cast("string"))
    places = 2 if decimals is None else int(decimals)
    shown = {
        "fixed": lambda: fixed_text(x, places),
        "percent": lambda: F.concat(fixed_text(x * 100, places), F.lit("%")),
        "scientific": lambda: scientific_text(x),
        "currency": lambda: F.concat(F.lit(CURRENCIES.get(currency, "")), fixed_text(x, places)),
    }.get(kind)
    return text if shown is None else F.when(column.isNotNull() & x.isNotNull() & ~F.isnan(x), shown()).otherwise(text)


def format_columns(df: DataFrame, formats: dict[str, dict]) -> DataFrame:
    require(df, *formats)

    def cell(c: str) -> Column:
        kind = df.schema[c].dataType
        number = col(c).cast("double") if is_numeric(kind) else col(c).cast("int").cast("double") if isinstance(kind, T.BooleanType) else None
        return formatted(col(c), number=number, **formats[c]).alias(c)

    return df.select(*[cell(c) if c in formats else col(c) for c in df.columns])
