"""Statistics of groups from runs of equal values, without a task that holds all values of a group.

Values are counted once into a table of runs ``(group, v, n)``, which is stored;
everything else is told from it: counts, means, deviations, bounds, distinct
values and exact quantiles.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.storage import durable

#: Runs that a window over one group may hold in a task; more are sorted by range and ranked part by part.
WINDOW_RUNS = 1_000_000


def runs_of(long: DataFrame, keys: list[str]) -> DataFrame:
    """The stored runs of ``(keys, v)`` or ``(keys, v, w)``: ``n`` rows have the value; null is a value, too."""
    return durable(long.groupBy(*keys, *[c for c in ("v", "w") if c in long.columns]).agg(F.count(F.lit(1)).alias("n")), "runs")


def ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs with a value and where they lie in the order of their group: ``start`` (from 0), ``end`` and ``total``.

    Few runs are ranked by one window.  Many are sorted by range and stored with
    the partition of the sort; a rank is then that within (group, partition) plus
    the counts of the group's partitions before.
    """
    some = runs.where("v is not null")
    names = [F.col(c) for c in some.columns]
    order = [c for c in ("v", "w") if c in runs.columns]  # what shares a double is told apart by its long
    so_far = (W.unboundedPreceding, W.currentRow)
    if runs.count() <= WINDOW_RUNS:  # from the files' footers
        group = W.partitionBy(*keys)
        end = F.sum("n").over(group.orderBy(*order).rowsBetween(*so_far))
        return some.select(*names, (end - F.col("n")).alias("start"), end.alias("end"), F.sum("n").over(group).alias("total"))
    sorted_ = durable(some.orderBy(*keys, *order).withColumn("part", F.spark_partition_id()), "sorted")
    group = W.partitionBy(*keys).orderBy("part")
    sums = sorted_.groupBy(*keys, "part").agg(F.sum("n").alias("sum"))
    sums = sums.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("part").alias("b_part"), (F.sum("sum").over(group) - F.col("sum")).alias("before"), F.sum("sum").over(W.partitionBy(*keys)).alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    both = sorted_.join(sums, reduce(and_, same, F.col("part") == F.col("b_part")))
    end = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "part").orderBy(*order).rowsBetween(*so_far))
    return both.select(*names, (end - F.col("n")).alias("start"), end.alias("end"), "total")


def _cut(total, share: float) -> tuple:
    """Of a quantile: the aggregates of the values around it and the weight of the upper one, and how to join them."""
    place = (total - 1) * F.lit(float(share))
    at = lambda rank: F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("v")))
    return at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))


def statistics(runs: DataFrame, keys: list[str], shares: list[float] = ()) -> DataFrame:
    """A row per group of ``runs``: ``rows, n, mean, std, low, high, sum, distinct`` and ``q``, an array of the quantiles.

    Quantiles are interpolated between ranks; NaN is the greatest value.  The
    deviation is taken around the group's mean, in a second pass over the runs.
    """
    weight, group = F.col("n").cast("double"), W.partitionBy(*keys)
    placed = ranked(runs, keys) if shares else runs.where("v is not null").withColumn("total", F.sum("n").over(group))
    same = lambda a, b: reduce(and_, [a[k].eqNullSafe(b[f"m_{k}"]) for k in keys])
    means = runs.where("v is not null").groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg((F.sum(F.col("v") * weight) / F.sum("n")).alias("middle"))
    placed = placed.join(means, same(placed, means))
    apart = F.col("v") - F.col("middle")
    cuts = [c.alias(f"{name}{i}") for i, s in enumerate(shares) for name, c in zip(("lo", "hi", "w"), _cut(F.col("total"), s))]
    whole = [F.min("w").alias("low_w"), F.max("w").alias("high_w")] if "w" in runs.columns else []
    found = placed.groupBy(*keys).agg(
        F.max("total").alias("n"), F.max("middle").alias("mean"), F.sum(apart * apart * weight).alias("square"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.sum(F.col("v") * weight).alias("sum"), F.count(F.lit(1)).alias("distinct"), *whole, *cuts,
    )
    low, high, part = (lambda i: F.col(f"lo{i}")), (lambda i: F.col(f"hi{i}")), (lambda i: F.col(f"w{i}"))
    value = [F.when(low(i) == high(i), low(i)).otherwise(low(i) * (1 - part(i)) + high(i) * part(i)) for i in range(len(shares))]
    std = F.when(F.col("n") > 1, F.sqrt(F.col("square") / (F.col("n") - 1)))
    found = found.select(*[F.col(k).alias(f"m_{k}") for k in keys], "n", "mean", std.alias("std"), "low", "high", "sum", "distinct", *[c for c in ("low_w", "high_w") if whole], (F.array(*value) if value else F.lit(None)).alias("q"))
    every = runs.groupBy(*keys).agg(F.sum("n").alias("rows"))  # groups without a value come out, too
    out = every.join(found, same(every, found), "left").drop(*[f"m_{k}" for k in keys])
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "distinct": F.coalesce("distinct", F.lit(0))})


def rank_quantiles(long: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """``keys`` and ``q``, an array of the quantiles (interpolated) of the double ``v`` of each group of ``(keys, v)`` that has a value."""
    placed = ranked(runs_of(long, keys), keys)
    cuts = [c.alias(f"{name}{i}") for i, s in enumerate(shares) for name, c in zip(("lo", "hi", "w"), _cut(F.col("total"), s))]
    low, high, part = (lambda i: F.col(f"lo{i}")), (lambda i: F.col(f"hi{i}")), (lambda i: F.col(f"w{i}"))
    value = [F.when(low(i) == high(i), low(i)).otherwise(low(i) * (1 - part(i)) + high(i) * part(i)) for i in range(len(shares))]
    return placed.groupBy(*keys).agg(*cuts).select(*keys, F.array(*value).alias("q"))
