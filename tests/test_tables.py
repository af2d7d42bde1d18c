import pytest

from tessera.operators import stats, tables
from tessera.operators.rowid import assign_row_id


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in tables.sort(df, ["x"], ["asc"]).orderBy("_row_id").collect()] == [1, 2, None]
    assert [r.x for r in tables.sort(df, ["x"], ["DESC"]).orderBy("_row_id").collect()] == [2, 1, None]


def test_row_ids_are_consecutive_over_many_partitions(spark):
    df = spark.range(5000).repartition(7)
    out = assign_row_id(df, df["id"].desc()).collect()
    assert sorted(r._row_id for r in out) == list(range(1, 5001))
    assert all(r.id == 5000 - r._row_id for r in out)


def test_row_ids_need_no_single_partition_window(spark):
    plan = assign_row_id(spark.range(10), *[])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_quartiles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x int")
    r = stats.column_stats(df, "x").first()
    assert (r["count"], r.missing, r.median, r.q1, r.unique_count) == (5, 1, 2.5, 1.75, 4)
    assert round(r.std_dev, 4) == 4.0825
    one = spark.createDataFrame([(1.0,)], "x double")
    assert stats.column_stats(one, "x").first().std_dev is None


def test_descriptive_stats_scans_once_and_keeps_large_integers_apart(spark, tmp_path):
    big = 2**53
    spark.createDataFrame([(big, 1.5, "a"), (big + 1, None, "b")], "i long, d double, s string").write.parquet(str(tmp_path / "t"))
    out = stats.descriptive_stats(spark.read.parquet(str(tmp_path / "t")))
    assert [(r.column_name, r.unique_count) for r in out.collect()] == [("i", 2), ("d", 1)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 3
    with pytest.raises(ValueError):
        stats.column_stats(spark.createDataFrame([("a",)], "s string"), "s")


def test_split_fixture(spark, collect):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, 5), (1, None, 3, 9), (2, "b", 4, 7)], "id int, k string, _row_id long, v int")
    assert collect(tables.split(df, "k", "v", ["id"])) == sorted([(1, None, None), (1, 5, None), (2, None, 7)], key=str)
    with pytest.raises(ValueError):
        tables.split(spark.createDataFrame([(1, None, 1)], "id int, k string, v int"), "k", "v")


def test_joins_and_update(spark, collect):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3), (9, "z", 4), (None, "m", 5)], "k int, v string, _row_id long")
    assert tables.join(left, right, "k", "k").columns == ["k", "v", "k_r", "v_r"]
    counts = {how: tables.join(left, right, "k", "k", how).count() for how in ("inner", "left", "right", "full", "odd")}
    assert counts == {"inner": 3, "left": 5, "right": 5, "full": 7, "odd": 3}
    assert collect(tables.update(left, right, "k", ["v"])) == sorted([(1, "y"), (2, None), (3, "c"), (None, "n")], key=str)
    clash = spark.createDataFrame([(1, "a", "b")], "k int, v string, v_r string")
    with pytest.raises(ValueError):
        tables.join(clash, right, "k", "k")


def test_concatenate_widens_and_refuses(spark, collect):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2.5)], "b string, c double")
    out = tables.concatenate([a, b])
    assert out.columns == ["a", "b", "c"] and collect(out) == sorted([(1, "x", None), (None, "y", 2.5)], key=str)
    text = spark.createDataFrame([("q",)], "a string")
    assert collect(tables.concatenate([a.select("a"), text])) == [("1",), ("q",)]
    flag = spark.createDataFrame([(True,)], "a boolean")
    assert collect(tables.concatenate([a.select("a"), flag])) == [(1,), (1,)]
    day = spark.sql("select date '2024-01-01' as a")
    with pytest.raises(ValueError):
        tables.concatenate([a.select("a"), day])
    with pytest.raises(ValueError):
        tables.concatenate([a.select("a"), spark.createDataFrame([(1,)], "A int")])


def test_stack_keeps_nulls_and_orders_blocks(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, 4)], "_row_id long, a int, b int")
    out = tables.stack(df, ["a", "b"], [], number_rows=True).orderBy("_row_id").collect()
    assert [(r.Label, r.Value) for r in out] == [("a", 1), ("a", None), ("b", None), ("b", 4)]
    mixed = spark.createDataFrame([(1, "x", 2.5)], "i int, a string, b double")
    assert sorted(r.Value for r in tables.stack(mixed, ["i", "a", "b"], []).collect()) == ["1", "2.5", "x"]


def test_stack_then_split_gives_the_table_back(spark, collect):
    df = spark.createDataFrame([(1, 10, 20), (2, None, 40), (3, 50, None)], "id int, a int, b int")
    long = tables.stack(df, ["a", "b"], ["id"])
    assert collect(tables.split(long, "Label", "Value", ["id"])) == collect(df)


def test_transpose_twice_gives_the_text_back(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "_row_id long, x string, y int")
    once = tables.transpose(df)
    assert [tuple(r) for r in once.collect()] == [("x", "a", None), ("y", "5", "6")]
    with pytest.raises(ValueError):
        tables.transpose(df.select("_row_id"))


def test_odd_names(spark):
    names = ["a.b", "c d", "e`f", "列1", 'g"h']
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], names)
    assert tables.subset(df, names[::-1]).columns == names[::-1]
    assert tables.summary(df, names, [], ["sum"]).first()["e`f_Sum"] == 3.0
    assert tables.stack(df, names, []).count() == 5
    assert [r.column_name for r in stats.descriptive_stats(df).collect()] == names


def test_summary_errors(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    with pytest.raises(ValueError):
        tables.summary(df, [], [])
    with pytest.raises(ValueError):
        tables.summary(df, ["s"], [], ["mean"])


def test_selection_statistics(spark):
    block = spark.createDataFrame([(1, True, ""), (2, None, "7")], "a int, b boolean, c string")
    r = stats.selection_stats(block).first()
    assert (r["count"], r["sum"], r["max"]) == (5, 11.0, 7.0)
    r = stats.selection_stats(spark.createDataFrame([("x",), ("1",)], "c string")).first()
    assert (r["count"], r["sum"]) == (2, None)
