"""Quantiles by rank against numpy, with groups, repeats and missing values."""

import random

import numpy as np
from tessera.operators import explore, stats, tables
from tessera.operators.quantiles import rank_quantiles


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), float(rng.choice([rng.randrange(9), rng.random()]))) for _ in range(3000)] + [("c", None), ("d", 4.0), (None, None)]
    got = {r.g: r.q for r in rank_quantiles(spark.createDataFrame(data, "g string, v double").repartition(7), ["g"], [0, 0.25, 0.5, 0.9, 1]).collect()}
    groups = {g: [v for h, v in data if h == g and v is not None] for g in ("a", "b", None, "d")}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))


def test_summary_with_medians_of_groups(spark):
    df = spark.createDataFrame([("a", None, 1, 5.0), ("a", None, 4, None), ("b", "x", 7, None), (None, "x", 2, 2.0), (None, "x", 4, 3.0)], "g string, `h i` string, v int, w double")
    out = {(r[0], r[1]): tuple(r)[2:] for r in tables.summary(df, ["v", "w"], ["g", "h i"], ["median", "n"]).collect()}
    assert out == {("a", None): (2.5, 2, 5.0, 1), ("b", "x"): (7.0, 1, None, 0), (None, "x"): (3.0, 2, 2.5, 2)}
    assert tuple(tables.summary(df, ["v"], [], ["median", "max"]).first()) == (4.0, 7)
    assert tuple(tables.summary(df, ["v"], [], ["median"]).first()) == (4.0,)
    none = tables.summary(df.where("false"), ["v"], [], ["n", "median"]).first()
    assert tuple(none) == (0, None) and stats.column_stats(df.where("false"), "v").count() == 0


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    assert [tuple(r) for r in explore.histogram(df, "x", 2).orderBy("bin").collect()] == [(1, 1.0, 1), (2, 1.5, 1)]
