"""Plans: what reaches the scan, what is broadcast, what is windowed."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import explore, filters, stats, tables
from tessera.operators.rowid import assign_row_id


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("w") / "t")
    spark.range(1000).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 1.5).alias("x"), F.lit("text").alias("unused")).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(wide):
    p = plan(tables.subset(wide, ["id"], "x > 100"))
    assert "GreaterThan(x,100.0)" in p and "unused" not in p
    p = plan(wide.where(filters.value_range("x", 10, 20)).select("id"))
    assert "GreaterThanOrEqual(x,10.0)" in p and "unused" not in p


def test_pages_are_top_k(wide):
    assert "TakeOrderedAndProject" in plan(tables.page(wide.withColumnRenamed("id", "_row_id"), 2, 10, "x", "desc"))


def test_no_window_without_partition(wide):
    assert "Window" not in plan(assign_row_id(wide, F.col("x").desc()))
    assert "Window" not in plan(tables.sort(wide, ["g", "id"], ["desc", "asc"]))


def test_statistics_scan_once_and_combine_before_the_shuffle(wide):
    p = plan(stats.descriptive_stats(wide))
    # The table once; the stored ranks of its values twice.
    assert p.count("FileScan") == 3 and "unused" not in p and "percentile" not in p and "CartesianProduct" not in p
    p = plan(tables.summary(wide, ["x"], ["g"], ["mean", "sum"]))
    assert "partial_avg" in p and p.count("Exchange") == 1


def test_no_python_in_table_operators(wide):
    for df in (tables.stack(wide, ["g", "x"], ["id"]), tables.update(wide, wide, "id", ["x"]), explore.correlations(wide, ["g", "x"]), stats.selection_stats(wide)):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_histogram_edges(spark):
    one = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [tuple(r) for r in explore.histogram(one, "x", 4).collect()] == [(1, 2.0, 2)]
    some = spark.createDataFrame([(0.0,), (1.0,), (4.0,)], "x double")
    assert sorted((r.bin, r["count"]) for r in explore.histogram(some, "x", 4).collect()) == [(1, 1), (2, 1), (3, 0), (4, 1)]
    with pytest.raises(ValueError):
        explore.predicate("x", "like")
