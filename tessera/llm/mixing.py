"""Mixing sources to target token shares by entropy balancing.

Of all document rates ``0 <= r <= cap`` that give each source its target of
words, entropy balancing takes those nearest to 1 in relative entropy:
``r = min(cap, exp(lambda_s * size / scale_s))``.  The dual is convex with one
variable per source; Newton steps (kept inside a bracket) solve it, each step
one aggregation over the ``(source, size)`` histogram.  The rates are then
rounded into whole copies by systematic sampling along documents ordered by
size class, so that each source's words come within a few documents of its
target.  Sums are exact (decimal or integer), so reruns agree.

Only rows per *source* reach the driver; more than ``MAX_SOURCES`` sources are
refused.  What the driver found per source goes back as a literal, so that no
Python worker takes part.  Nothing partitions by source alone: documents are
ranked within (source, size class, salt); the table of those cells (one per
20,000 documents, class and source) is broadcast only while Catalyst finds it
below ``spark.sql.autoBroadcastJoinThreshold``.

Defined cases: null or empty text has size 0 and is taken at rate 1 (0 words);
null source is a source, ordered last; rows of equal id, source and size share the
copies of all of them, so that each is taken as often as another or once more; an
empty table gives an empty result; other columns pass through ``mix``.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .durable import durable

WEIGHTS, SHARE, CAP = (3, 1, 2), Fraction(3, 2), 2
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
_ONE = 1 << 20  # a rate of 1 in fixed point
_OFFSETS = 16
_SALT_ROWS = 20_000
#: Numbers in an array that repeats a row.
_BLOCK = 8192


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, cap: int = CAP) -> dict[str | None, Fraction]:
    """Each source's target: ``share`` of all words by weight, at most ``cap`` times the source, the excess reshared."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = Fraction(share) * sum(sizes.values())
    free, out = list(names), {}
    while free:
        left, sum_w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / sum_w > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum_w for s in free}
        out |= {s: Fraction(cap * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return out


def _solve(hist: DataFrame, goals: dict, sizes: dict, scale: dict, cap: int) -> dict:
    """lambda per source; None where every rate is the cap."""
    lam = {s: 0.0 for s, goal in goals.items() if 0 < goal < cap * sizes[s]}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    done: dict = {}
    for _ in range(60):
        if not lam:
            break
        known = _literal(hist.sparkSession, [{"key": s, "lam": at, "scale": scale[s]} for s, at in lam.items()], "key string, lam double, scale double")
        now = hist.join(known, hist["source"].eqNullSafe(known["key"]))
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        words = (F.col("n") * F.col("size")).cast("double")
        exact = lambda c: F.sum(F.round(c, 6).cast("decimal(38,6)"))
        sums = now.groupBy("key").agg(exact(words * F.least(raw, F.lit(float(cap)))).alias("got"), exact(F.when(raw < cap, words * x * raw).otherwise(0.0)).alias("slope")).collect()
        for s, got, slope in sums:
            miss, at = float(got) - float(goals[s]), lam[s]
            if abs(miss) <= max(1e-9 * float(goals[s]), 1e-3):
                done[s] = lam.pop(s)
                continue
            (high if miss > 0 else low)[s] = at
            step = at - miss / float(slope) if slope else math.inf
            if not low[s] < step < high[s]:
                a, b = low[s], high[s]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else 2 * at + 1 if math.isinf(b) else 2 * at - 1
            if step == at:
                done[s] = lam.pop(s)
            else:
                lam[s] = step
    return {s: None if goals[s] >= cap * sizes[s] else round(done.get(s, lam.get(s, 0.0)), 12) for s in goals}


def _literal(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    """A small table as one literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")))


def _class(size: Column) -> Column:
    """Size classes of an eighth of an octave."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 8).cast("int")


def copies(sized: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """From ``(id, source, size)``: a row per distinct one with ``source_size`` and ``target``; of its ``m`` rows, ``more`` are taken ``low + 1`` times and the others ``low`` times."""
    spark = sized.sparkSession
    rows = durable(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sized")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.sum("m").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes, scale = {r[0]: r[1] for r in per}, {r[0]: max(r[1] / r[2], 1.0) for r in per}
    goals = targets(sizes, weights, share, cap)
    hist = durable(rows.groupBy("source", "size").agg(F.sum("m").alias("n")), "hist")
    lam = _solve(hist, goals, sizes, scale, cap)
    rows_known = [{"key": s, "lam": lam[s], "scale": scale[s], "source_size": sizes[s], "target": float(goals[s])} for s in goals]
    known = _literal(spark, rows_known, "key string, lam double, scale double, source_size bigint, target double")
    salts = max(16, sum(r[2] for r in per) // _SALT_ROWS)
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0)))))
    rated = rows.join(known, rows["source"].eqNullSafe(known["key"])).select(
        "id", "source", "size", "m", "source_size", "target",
        F.round(rate * _ONE).cast("long").alias("each"), (F.round(rate * _ONE).cast("long") * F.col("m")).alias("rate"), _class(F.col("size")).alias("c"),
        F.pmod(F.xxhash64(F.col("id").cast("string"), "size"), F.lit(salts)).alias("b"),
    )
    cells = rated.groupBy("source", "c", "b").agg(F.sum("rate").alias("rate"))
    strata = cells.groupBy("source", "c").agg(F.sum("rate").alias("rate"))
    strata = strata.select("source", "c", (F.sum("rate").over(W.partitionBy("source").orderBy("c")) - F.col("rate")).alias("base"))
    cells = cells.select("source", "c", "b", (F.sum("rate").over(W.partitionBy("source", "c").orderBy("b")) - F.col("rate")).alias("base"))
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    start = cells.join(strata, same(cells, strata, ("source", "c"))).select(cells["source"], cells["c"], cells["b"], (cells["base"] + strata["base"]).alias("base"))
    order = W.partitionBy("source", "c", "b").orderBy("size", F.col("id").cast("string"))
    run = rated.withColumn("run", F.sum("rate").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    placed = run.join(start, same(run, start, ("source", "c", "b"))).select(run["id"], run["source"], "size", "m", "source_size", "target", (F.col("base") + F.col("run")).alias("end"), "rate", "each")
    placed = durable(placed, "placed")

    def count(offset: Column) -> Column:
        return F.floor((F.col("end") + offset) / _ONE) - F.floor((F.col("end") - F.col("rate") + offset) / _ONE)

    tried = placed.groupBy("source").agg(*[F.sum(F.col("size") * count(F.lit(j * _ONE // _OFFSETS))).alias(f"w{j}") for j in range(_OFFSETS)]).collect()
    best = [{"key": r[0], "shift": min(range(_OFFSETS), key=lambda j: (abs(r[j + 1] - goals[r[0]]), j)) * _ONE // _OFFSETS} for r in tried]
    shift = _literal(spark, best, "key string, shift bigint")
    low = F.shiftright("each", 20)
    dealt = placed.join(shift, placed["source"].eqNullSafe(shift["key"])).withColumn("low", low)
    return dealt.select("id", "source", "size", "m", "source_size", "target", "low", (count(F.col("shift")) - F.col("low") * F.col("m")).alias("more"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    sized = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].cast("string").alias("source"), word_count(docs[f"`{text_col}`"]).alias("size"))
    out = copies(sized, **options)
    parts = F.inline(F.array(F.struct((F.col("low") + 1).alias("copies"), F.col("more").alias("times")), F.struct(F.col("low").alias("copies"), (F.col("m") - F.col("more")).alias("times"))))
    out = _repeated(out.select("id", "size", "source_size", "target", parts), F.col("times")).drop("times")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _repeated(df: DataFrame, times: Column) -> DataFrame:
    """Every row ``times`` times; no row holds more than a block of numbers, whatever ``times`` is."""
    whole = F.ceil(times / _BLOCK).cast("long")
    blocks = df.withColumn("__times", times).where("__times > 0").withColumn("__block", F.explode(F.sequence(F.lit(1).cast("long"), whole)))
    left = F.least(F.lit(_BLOCK).cast("long"), F.col("__times") - (F.col("__block") - 1) * _BLOCK)
    return blocks.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("__times", "__block", "__one")


def _ranked_equals(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``place`` among those of equal id, source and size, without a task that holds a whole group.

    The rows are stored with their partition; a place is that within the
    partition and the counts of the partitions before.
    """
    keys = ["__id", "__source", "__size"]
    at = F.monotonically_increasing_id()
    kept = durable(rows.select("*", F.shiftright(at, 33).alias("__part"), at.alias("__at")), "equals")
    counts = kept.groupBy(*keys, "__part").count()
    counts = counts.select(*[F.col(k).alias(f"b{k}") for k in keys], F.col("__part").alias("b_part"), (F.sum("count").over(W.partitionBy(*keys).orderBy("__part")) - F.col("count")).alias("before"))
    same = [F.col(k).eqNullSafe(F.col(f"b{k}")) for k in keys]
    both = kept.join(counts, [*same, F.col("__part") == F.col("b_part")])
    return both.withColumn("place", F.col("before") + F.row_number().over(W.partitionBy(*keys, "__part").orderBy("__at")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    keys = {"__id": docs[f"`{id_col}`"], "__source": docs[f"`{source_col}`"].cast("string"), "__size": word_count(docs[f"`{text_col}`"])}
    sized = docs.select(*[c.alias(k[2:]) for k, c in keys.items()])
    out = copies(sized, **options).where("low > 0 or more > 0").select("id", "source", "size", "m", "low", "more")
    keyed = docs.withColumns(keys)
    same = lambda t: keyed["__id"].eqNullSafe(t["id"]) & keyed["__source"].eqNullSafe(t["source"]) & (keyed["__size"] == t["size"])
    alike, split = out.where("more = 0 or more = m"), out.where("more > 0 and more < m")
    taken = F.col("low") + (F.col("more") > 0).cast("long")
    whole = keyed.join(alike, same(alike)).select(*[keyed[f"`{c}`"] for c in docs.columns], taken.alias("__copies"))
    if not split.isEmpty():
        some = _ranked_equals(keyed.join(split, same(split)).select(*[keyed[f"`{c}`"] for c in keyed.columns], "low", "more"))
        whole = whole.unionAll(some.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("low") + (F.col("place") <= F.col("more")).cast("long")).alias("__copies")))
    return _repeated(whole, F.col("__copies")).drop("__copies")


def op2_entropy_balancing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")
