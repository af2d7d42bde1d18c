"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``.

    The label is the smallest node reachable.  Large-star and small-star steps
    alternate until the edges are stars; each step is two aggregations with
    partial sums, so a hub never meets in one task, and every round is written
    to the shared folder to end its lineage.  Every edge leads to a smaller
    node, so in a star the centre is the smallest.  Nothing but the answer
    whether stars are reached comes to the driver.  Edges with a null end are
    left out; an empty edge table gives an empty result.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not _are_stars(now):
        # Large star: each node hands its larger neighbours to its smallest one.
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # Small star: each node hands itself and its smaller neighbours to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges (u, v)`` that leads to a node leads to one only and none leads to it."""
    end = lambda node, leads, led: F.struct(F.col(node).alias("node"), F.lit(leads).alias("leads"), F.lit(led).alias("led"))
    ends = edges.select(F.inline(F.array(end("u", 1, 0), end("v", 0, 1))))
    sums = ends.groupBy("node").agg(F.sum("leads").alias("leads"), F.max("led").alias("led"))
    return sums.where("leads > 1 or leads = 1 and led = 1").isEmpty()
