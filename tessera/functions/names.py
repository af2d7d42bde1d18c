"""Column names: quoting and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col(quoted(name))


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def distinct_names(names: list[str]) -> None:
    """Names that differ in nothing but case are refused: Spark can't tell them apart."""
    seen: dict[str, str] = {}
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"column {name!r} clashes with {seen[name.lower()]!r}")
        seen[name.lower()] = name


def absent(df: DataFrame, *names: str) -> None:
    distinct_names([*df.columns, *names])
