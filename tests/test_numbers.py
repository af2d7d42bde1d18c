"""Texts as numbers and dates against DuckDB's casts, numbers of the grid, and decimals rounded from exact values."""

import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.numbers import fixed_text, grid_number, scientific_text
from tessera.functions.types import convert, spark_type
from tessera.operators import columns, edits, stats

TEXT = spark_type("VARCHAR")


def made_up(seed, alphabet, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


NUMBERS = [
    "1d", "1f", "1L", " 5 ", "+5", "-5", "5.", "5.5", ".5", "1e3", "1e", "0x10", "0X1f", "-0x10", "0b101", "1_000", "1__0", "_1", "inf", "-inf", "Infinity", "nan", "1e400", "1e39", "9223372036854775807",
    "9223372036854775808", "-9223372036854775808", "2147483648", "1.5e2", "1e-3", "0.5", "1.5", "2.5", "-2.5", "-0.5", "99999999999999999999.4", "", "  ", "abc", "1 2", "1,5", "00012", "2147483647.4", "2147483647.5",
]
DATES = [
    "2024", "2024-1", "2024-1-5", "2024-01-05", "2024/1/5", "2024/01/05", "2024-02-30", "2024-13-01", "2024-01-05 10:00:00", "2024-01-05T10:00:00", "2024-01-05x", "20240105", "01/02/2024", "2024-01/05", "2024.01.05",
    "2024 01 05", "2024-01-05 25:00:00", "2024-01-05 10:00", "2024-01-05 10", "2024-01-05 10:00:00.123456", "2024-01-05 1:2:3", "2024-01-05 10:00:60", "10:00:00", "1d", "", "0001-01-01", "2023-02-29", "2024-02-29",
]


@pytest.mark.parametrize("kind", ["INTEGER", "BIGINT", "DOUBLE"])
def test_texts_are_numbers_as_in_duckdb(spark, kind):
    texts = NUMBERS + [t for t in made_up(1, "0123456789.+-eE_xd ", 1500) if not re.search(r"^ *\+0[xb]|[eE].*\.", t)]  # two oddities: a sign before another base, a point after an exponent
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = dict(map(tuple, df.select("t", convert(F.col("t"), TEXT, kind)).collect()))
    want = {t: duckdb.execute(f"SELECT TRY_CAST(? AS {kind})", [t]).fetchone()[0] for t in texts}
    same = lambda a, b: a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-15)))
    assert [(t, got[t], want[t]) for t in texts if not same(got[t], want[t])] == []


@pytest.mark.parametrize("kind", ["DATE", "TIMESTAMP"])
def test_texts_are_dates_as_in_duckdb(spark, kind):
    texts = DATES + ["2024-" + t for t in made_up(2, "0123-/ :", 800)]
    texts = [t for t in texts if kind == "DATE" or t == t.strip()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = dict(map(tuple, df.select("t", convert(F.col("t"), TEXT, kind)).collect()))
    want = {t: duckdb.execute(f"SELECT TRY_CAST(? AS {kind})", [t]).fetchone()[0] for t in texts}
    assert [(t, got[t], want[t]) for t in texts if got[t] != want[t]] == []


def test_numbers_of_the_grid(spark):
    cases = {
        "0x10": 16, "0XfF": 255, "0o17": 15, "0b101": 5, "-0x10": None, "": 0, "  ": 0, "\t\n": 0, " 5 ": 5, "1d": None, "1f": None, "1e3": 1000, "1E-2": 0.01, ".5": 0.5, "5.": 5, "+5": 5, "Infinity": math.inf,
        "-Infinity": -math.inf, "inf": None, "nan": None, "1_000": None, "1,5": None, "0x": None, "0xg": None, "true": None, "00012": 12, "1e400": math.inf, " 7 ": 7, "2024-01-01": None, "0x1fffffffffffff": 2**53 - 1,
        "0x20000000000001": float(2**53 + 1), "0x" + "f" * 40: float(int("f" * 40, 16)),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.x for r in df.select("t", grid_number(F.col("t")).alias("x")).collect()}
    assert got == {t: v if v is None else float(v) for t, v in cases.items()}


def test_decimals_come_from_the_exact_value(spark):
    rng = random.Random(5)
    values = [1.005, 2.675, 1.115, 0.125, 0.375, -0.125, 0.5, 1.5, 2.5, -2.5, 1e20, 1e21, 123456789.125, 2**52 + 0.5, 0.0, -0.0, -0.001, 1 / 3, 5e-324, 8.345, 1.45]
    values += [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(-3, 12) for _ in range(300)] + [rng.randrange(-10**6, 10**6) / 16 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 3, 7):
        got = [r[0] for r in df.select(fixed_text(F.col("x"), places)).collect()]

        def want(v):
            if abs(v) >= 1e21:
                return f"{v:e}".replace(".000000", "")
            shown = str(Decimal(abs(v)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))
            return ("-" if v < 0 else "") + format(Decimal(shown), "f")

        assert [(v, g, want(v)) for v, g in zip(values, got) if g != want(v)] == []
    odd = spark.createDataFrame([(math.inf,), (-math.inf,), (0.0,), (1e21,), (1.5,)], "x double")
    assert [r[0] for r in odd.select(scientific_text(F.col("x"))).collect()] == ["Infinity", "-Infinity", "0e+0", "1e+21", "1.5e+0"]


def test_formats_of_texts(spark):
    df = spark.createDataFrame([("1d",), ("0x10",), ("",), (None,), ("x",), ("2.5",)], "t string")
    assert [r[0] for r in columns.format_columns(df, {"t": {"kind": "fixed"}}).collect()] == ["1d", "16.00", "0.00", "", "x", "2.50"]
    assert [r[0] for r in columns.format_columns(df.where("t = '2.5'"), {"t": {"kind": "currency", "currency": "XYZ"}}).collect()] == ["2.50"]
    flags = spark.createDataFrame([(True,), (None,)], "b boolean")
    assert [r[0] for r in columns.format_columns(flags, {"b": {"kind": "fixed", "decimals": 0}}).collect()] == ["1", ""]


def test_statistics_of_a_selection(spark):
    block = spark.createDataFrame([("0x10", 1.0, True), ("", None, False), (None, 2.5, None)], "t string, x double, b boolean")
    assert tuple(stats.selection_stats(block).first()) == (6, 20.5, 20.5 / 6, 0.0, 16.0)
    assert tuple(stats.selection_stats(spark.createDataFrame([("1d",), ("2",)], "t string")).first()) == (2, None, None, None, None)


def test_refused_edits_leave_the_cell(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "_row_id long, n int, s string")
    batch = spark.createDataFrame([(1, "n", "7", 1), (1, "n", "abc", 2), (2, "n", "abc", 1), (2, "s", "", 1)], "_row_id long, column string, value string, seq int")
    assert sorted(map(tuple, edits.apply_cell_edits(df, batch).collect())) == [(1, 7, "a"), (2, 6, None)]
    assert sorted((r._row_id, r.value, r.reason) for r in edits.rejected_edits(df, batch).collect()) == [(1, "abc", "no INTEGER"), (2, "abc", "no INTEGER")]
    with pytest.raises(ValueError, match="row 1, n: no INTEGER|row 2, n: no INTEGER"):
        edits.apply_cell_edits(df, batch, all_or_nothing=True)
