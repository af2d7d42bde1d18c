import pytest
from pyspark.sql import functions as F

from tessera.functions.types import convert, spark_type
from tessera.operators import columns, edits, filters

TEXT = spark_type("VARCHAR")


def test_text_to_integer_rounds_half_away(spark):
    df = spark.createDataFrame([("1.5",), ("2.5",), ("-2.5",), ("1e3",), (" 7 ",), ("1,000",), ("",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(convert(F.col("s"), TEXT, "INTEGER")).collect()] == [2, 3, -3, 1000, 7, None, None, None, None]


def test_double_to_integer_rounds_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(convert(F.col("x"), spark_type("DOUBLE"), "INTEGER")).collect()] == [0, 2, 2, 4, -2]


def test_text_to_date_and_boolean(spark):
    df = spark.createDataFrame([("2024/1/5", "yes"), ("2024-01-05", "t"), ("nope", "maybe")], "d string, b string")
    got = df.select(convert(F.col("d"), TEXT, "DATE").cast("string"), convert(F.col("b"), TEXT, "BOOLEAN")).collect()
    assert [tuple(r) for r in got] == [("2024-01-05", True), ("2024-01-05", True), (None, None)]


def test_change_type_counts_failures(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    with pytest.raises(ValueError, match="1 values of s"):
        columns.change_type(df, {"s": "INTEGER"})
    assert columns.change_type(df.where("s <> 'x'"), {"s": "DOUBLE"}).dtypes == [("s", "double")]


def test_detection_order(spark):
    cases = {"i": ["1", "0", "1"], "d": ["1", "2.5", ""], "b": ["yes", "no", "true"], "dt": ["2024-1-5", "2024/01/06", "2024-02-29"], "v": ["a", "1", "2"], "e": ["", " ", None], "bad": ["2024-02-30", "2024-1-1", "2024-1-2"], "big": ["1", "3000000000", "2"], "nan": ["NaN", "1", "2"]}
    df = spark.createDataFrame(list(zip(*cases.values())), ", ".join(f"{k} string" for k in cases))
    got = {r.column_name: r.detected for r in columns.detect_types(df).collect()}
    assert got == {"i": "INTEGER", "d": "DOUBLE", "b": "BOOLEAN", "dt": "DATE", "v": "VARCHAR", "e": "VARCHAR", "bad": "VARCHAR", "big": "BIGINT", "nan": "VARCHAR"}


def test_formats(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1234.5,), (-0.07,), (12345678.0,)], "x double")
    show = lambda **k: [r[0] for r in df.select(columns.formatted(F.col("x"), **k)).collect()]
    assert show(kind="fixed") == ["", "0.00", "1234.50", "-0.07", "12345678.00"]
    assert show(kind="percent", decimals=0)[3] == "-7%"
    assert show(kind="scientific") == ["", "0e+0", "1.2345e+3", "-7e-2", "1.2345678e+7"]
    assert show(kind="currency", currency="USD")[2] == "$1234.50"
    assert spark.createDataFrame([("abc",)], "x string").select(columns.formatted(F.col("x"), "fixed")).first()[0] == "abc"


def test_column_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for bad in (lambda: columns.add_column(df, "A"), lambda: columns.delete_column(df, "z"), lambda: columns.rename_column(df, "a", "B"), lambda: columns.delete_column(df.select("a"), "a")):
        with pytest.raises(ValueError):
            bad()
    assert columns.add_columns(df, 2).columns == ["a", "b", "列1", "列2"]
    assert columns.rename_column(df, "a", "A").columns == ["A", "b"]


def test_filters(spark, collect):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "b"), (3.0, "")], "x double, s string")
    assert df.where(filters.value_range("x", 1, "")).count() == 2
    assert df.where(filters.value_range("x", "", "q")).count() == 4
    assert df.where(filters.discrete("s", [""])).count() == 2
    nums = spark.createDataFrame([("10",), ("9",), (None,), ("b",)], "s string")
    assert [r.value for r in filters.distinct_values(nums, "s").collect()] == ["9", "10", "", "b"]


def test_cell_edits_last_wins(spark, collect):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (5, "c", 3)], "_row_id long, s string, n int")
    new = spark.createDataFrame([(1, "s", "x", 1), (1, "s", "y", 2), (2, "n", "", 1), (5, "n", "2.5", 1), (9, "s", "q", 1)], "_row_id long, column string, value string, seq int")
    assert collect(edits.apply_cell_edits(df, new)) == [(1, "y", 1), (2, "b", None), (5, "c", 3)]


def test_append_and_delete(spark, collect):
    df = spark.createDataFrame([(1, "a"), (5, "b")], "_row_id long, s string")
    assert collect(edits.append_rows(df, 2)) == [(1, "a"), (5, "b"), (6, None), (7, None)]
    assert collect(edits.delete_rows(df, spark.createDataFrame([(1,)], "i long"))) == [(5, "b")]
    assert collect(edits.append_rows(df.where("false"), 1)) == [(1, None)]


def test_patch_block(spark, collect):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (5, "c", None)], "_row_id long, s string, e string")
    patch = spark.createDataFrame([(1, "x", "1", "p"), (2, "", "2", ""), (3, "z", "", "q")], "_row_id long, a string, b string, c string")
    out = edits.patch_block(df, patch, 2, 1, ["VARCHAR", "INTEGER", "VARCHAR"], ["t", "", "u"])
    assert out.columns == ["_row_id", "t", "e", "u"]
    assert collect(out) == sorted([(1, "a", None, None), (2, "x", 1, "p"), (5, "c", 2, None), (6, "z", None, "q")], key=str)
