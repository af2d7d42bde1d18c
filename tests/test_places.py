"""Pages, blocks and transposition by place: the right rows, and plans that open only what they need."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters, places, tables


def gaps(spark, n=2000, seed=1):
    ids = random.Random(seed).sample(range(1, 50 * n), n)
    return ids, spark.createDataFrame([(i, f"n{i}", i % 7) for i in ids], "_row_id long, s string, k long").repartition(5)


def test_a_deep_page_reads_one_or_two_parts(spark):
    whole = places.ordered(spark.range(2_100_000).select(F.col("id").alias("_row_id"), (F.col("id") % 13).alias("x")).repartitionByRange(12, "_row_id"), F.col("_row_id"))
    assert whole.rows == 2_100_000 and len(whole.parts) > 2
    got = whole.page(20_000, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(set(got.inputFiles())) <= 2 and "rangepartitioning" not in plan and "PushedFilters" in plan
    assert [r._row_id for r in got.collect()] == list(range(1_000_000, 1_000_050))
    assert whole.page(42_000, 50).count() == 0 and [r._row_id for r in whole.page(41_999, 50).collect()][-1] == 2_099_999


def test_pages_by_a_column(spark, monkeypatch):
    ids, df = gaps(spark)
    want = sorted(ids, key=lambda i: (-(i % 7), i))
    near = tables.page(df, 2, 30, "k", "desc")
    monkeypatch.setattr(tables, "TOP_ROWS", 0)
    far = tables.page(df, 2, 30, "k", "desc")
    assert [r._row_id for r in near.collect()] == [r._row_id for r in far.collect()] == want[60:90]


@pytest.mark.parametrize("corners", [(1, 3, 1, 2), (1999, 2500, 2, 1), (700, 10, 2, 2), (2001, 2002, 1, 1)])
def test_blocks_count_places(spark, corners):
    ids, df = gaps(spark)
    (a, b), (c, d) = sorted(corners[:2]), sorted(corners[2:])
    want = [(f"n{i}", i % 7)[c - 1 : d] for i in sorted(ids)][a - 1 : b]
    assert sorted(map(tuple, filters.slice_block(df, *corners).collect())) == sorted(want)
    assert sorted(map(tuple, places.by_id(df).block(*corners).collect())) == sorted(want)


def test_ids_without_gaps_are_filtered_where_they_are(spark):
    df = spark.range(1, 100).withColumnRenamed("id", "_row_id").withColumn("x", F.col("_row_id"))
    got = filters.slice_block(df, 5, 7, 1, 1)
    assert sorted(r.x for r in got.collect()) == [5, 6, 7] and "parquet" not in got._jdf.queryExecution().toString().lower()


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(places, "_FEW_PARTS", 1)
    ids, df = gaps(spark)
    whole = places.by_id(df)
    got = whole.between(100, 1900)
    assert {r["__place"]: r["_row_id"] for r in got.collect()} == {k: i for k, i in enumerate(sorted(ids), 1) if 100 <= k <= 1900}


def test_transposition_in_tiles(spark):
    n = 50_000
    df = spark.range(n).select((F.col("id") * 3).alias("_row_id"), F.col("id").alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id"))).alias("b c")).repartition(7)
    tiles = tables.transpose_tiles(df)
    got = {(r.Label, r.block): r.cells for r in tiles.collect()}
    for label, cell in (("a", str), ("b c", lambda i: f"t{i}" if i % 5 else None)):
        assert [v for b in range(50) for v in got[label, b]] == [cell(i) for i in range(n)]
    last = tables.transpose_group(tiles, 49, n).collect()
    assert last[0].__fields__[0] == "Label" and last[0]["Row49001"] == "49000" and last[1]["Row50000"] == "t49999" and len(last) == 2
    with pytest.raises(ValueError):
        tables.transpose(df)


def test_small_transposition(spark, monkeypatch):
    df = spark.createDataFrame([(9, "x", 1), (2, None, 2), (5, "z", 3)], "_row_id long, s string, n long")
    want = [("s", None, "z", "x"), ("n", "2", "3", "1")]
    assert list(map(tuple, tables.transpose(df).collect())) == want
    monkeypatch.setattr(tables, "TILE", 2)
    monkeypatch.setattr(tables.transpose_tiles, "__defaults__", (2,))
    got = tables.transpose(df)
    assert got.columns == ["Label", "Row1", "Row2", "Row3"] and list(map(tuple, got.collect())) == want
    assert list(map(tuple, tables.transpose(df.where("false")).collect())) == [("s",), ("n",)]


@pytest.mark.parametrize("column", ["s", "n", "d", "b", "x"])
def test_text_filters_reach_the_scan(spark, tmp_path, column):
    rows = "SELECT * FROM VALUES ('a', 1, DATE '2024-01-05', true, 1.5D), ('', 5, DATE '2024-02-05', false, -0.0D), (NULL, NULL, NULL, NULL, NULL), ('05', 50, DATE '1999-12-31', true, 1e10D) AS t(s, n, d, b, x)"
    spark.sql(rows).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for values in (["a", "05", "5", "1"], ["", "2024-01-05", "true", "1.5"], ["2024-1-5", "TRUE", "+5", "01", "1.0E10", "0.0"], [""], []):
        plain, typed = df.where(filters.discrete(column, values)), df.where(filters.discrete(column, values, df.schema[column].dataType))
        assert sorted(map(str, plain.collect())) == sorted(map(str, typed.collect()))
        wanted = spark.createDataFrame([(v,) for v in values], "v string")
        assert sorted(map(str, filters.discrete_rows(df, column, wanted).collect())) == sorted(map(str, plain.collect()))
    good = {"s": "a", "n": "5", "d": "2024-01-05", "b": "true", "x": "1.5"}[column]
    plan = df.where(filters.discrete(column, [good, ""], df.schema[column].dataType))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert f"IsNull({column})" in pushed and (f"EqualTo({column}" in pushed or f"In({column}" in pushed or column == "s")
