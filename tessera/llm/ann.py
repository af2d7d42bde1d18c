"""Approximate nearest neighbours by cosine: one HNSW graph per shard.

Vectors of one direction (unit components equal to ``GRAIN``) are one node: it
carries the rows with the smallest ids, as many as an answer can use, with their
own vectors.  So a vector that a third of all rows share neither fills a shard
nor disconnects a graph, and of parallel vectors, which tie, the smallest ids are
found.  Nodes are dealt by hash to shards of ``SHARD_NODES``, more where there
are many nodes (up to ``MOST_NODES``).  Each shard's navigable small-world graph
is stored as flat neighbour arrays (one matrix a level, and its filled lengths)
beside its vectors.  Queries of one vector are searched once.  They travel in
blocks; every block meets every shard, and the shard results are merged by exact
score (double precision, original vectors, at most 1), ties (to 12 places, since
the same angle can come out an ulp apart) to the smaller id.

Every query meets every shard because nothing routes it: on vectors without
clusters the nearest five lie scattered over most cells of any coarse partition
(the README has figures).  Work is queries times shards; larger shards slow its
growth until ``MOST_NODES``, from where on it is quadratic if the queries are a
share of the rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths never meet; rows with
equal id and vector are one candidate; a null id is no candidate and no query;
with too few candidates a query gets all of them; other columns take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .durable import durable

SHARD_NODES, MOST_NODES, SHARDS, QUERY_BLOCK = 4096, 32_768, 256, 16_384
#: Bytes of the vectors of a shard, which are one cell.
MOST_BYTES = 128 << 20
M, EF_BUILD, EF_SEARCH = 12, 80, 120
#: Unit components are equal if they round to the same multiple of this.
GRAIN = 1e-7


def _search_layer(unit: np.ndarray, q: np.ndarray, entry: list[int], ef: int, links: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int]]:
    """The ``ef`` nodes nearest to ``q`` that a best-first walk finds, nearest first."""
    seen = np.zeros(len(unit), dtype=bool)
    seen[entry] = True
    found = [(float(s), e) for s, e in zip(unit[entry] @ q, entry)]
    todo = [(-s, e) for s, e in found]
    heapq.heapify(found), heapq.heapify(todo)
    while todo:
        s, node = heapq.heappop(todo)
        if len(found) >= ef and -s < found[0][0]:
            break
        near = links[node, : sizes[node]]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        for s, e in zip((unit[near] @ q).tolist(), near.tolist()):
            if len(found) < ef:
                heapq.heappush(found, (s, e))
            elif s > found[0][0]:
                heapq.heapreplace(found, (s, e))
            else:
                continue
            heapq.heappush(todo, (-s, e))
    return sorted(found, reverse=True)


def _select(unit: np.ndarray, near: list[int], sims: np.ndarray, most: int) -> list[int]:
    """Neighbours that are nearer to the node than to any neighbour kept before, filled up with the rest."""
    among = unit[near] @ unit[near].T
    kept: list[int] = []
    spare: list[int] = []
    for i in range(len(near)):
        if len(kept) == most:
            break
        (kept if not kept or among[i, kept].max() < sims[i] else spare).append(i)
    kept += spare[: most - len(kept)]
    return [near[i] for i in kept]


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """A neighbour matrix per level (-1 where empty), how many neighbours each node has there, and the entry node."""
    unit = _unit(vectors)
    n = len(unit)
    draw = np.random.default_rng(n).random(n)
    levels = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int32)
    caps = [2 * m] + [m] * int(levels.max())
    links = [np.full((n, c), -1, dtype=np.int32) for c in caps]
    sizes = [np.zeros(n, dtype=np.int32) for _ in caps]
    entry = 0
    for node in range(1, n):
        q, top = unit[node], int(levels[node])
        at = [entry]
        for level in range(int(levels[entry]), -1, -1):
            if level > top:
                at = [_search_layer(unit, q, at, 1, links[level], sizes[level])[0][1]]
                continue
            found = _search_layer(unit, q, at, ef, links[level], sizes[level])
            at = [e for _, e in found]
            mine = _select(unit, at[: 3 * m], np.array([s for s, _ in found[: 3 * m]]), m)
            links[level][node, : len(mine)] = mine
            sizes[level][node] = len(mine)
            for other in mine:
                k = sizes[level][other]
                if k < caps[level]:
                    links[level][other, k] = node
                    sizes[level][other] = k + 1
                    continue
                near = np.append(links[level][other, :k], node)
                sims = unit[near] @ unit[other]
                order = np.argsort(-sims, kind="stable")
                keep = _select(unit, near[order].tolist(), sims[order], caps[level])
                links[level][other, : len(keep)] = keep
                links[level][other, len(keep) :] = -1
                sizes[level][other] = len(keep)
        if top > levels[entry]:
            entry = node
    return links, sizes, entry


def search(unit: np.ndarray, links: list[np.ndarray], sizes: list[np.ndarray], entry: int, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
    """Nodes near the unit vector ``q``, nearest first."""
    at = [entry]
    for level in range(len(links) - 1, 0, -1):
        at = [_search_layer(unit, q, at, 1, links[level], sizes[level])[0][1]]
    return [e for _, e in _search_layer(unit, q, at, ef, links[0], sizes[0])]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v, dim)`` of the rows that take part."""
    v = F.transform(F.col("v"), lambda x: x.cast("double"))
    out = rows.select(rows[f"`{id_col}`"].cast("long").alias("id"), rows[f"`{vector_col}`"].alias("v")).select("id", v.alias("v"), F.size("v").alias("dim"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return out.where(F.col("id").isNotNull() & (F.col("dim") > 0) & whole & F.exists("v", lambda x: x != 0))


def shard_count(nodes: int, size: int = 0) -> int:
    """Shards of ``SHARD_NODES`` nodes, beyond ``SHARDS`` of them larger ones, up to ``MOST_NODES`` nodes or about ``MOST_BYTES`` of the ``size`` of all vectors."""
    each = min(max(SHARD_NODES, -(-nodes // SHARDS)), MOST_NODES)
    return max(1, -(-nodes // each), -(-size // MOST_BYTES))


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """A row per shard of ``rows (id, v, dim)``: its nodes with their rows, and flat neighbour arrays."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    direction = F.transform("v", lambda x: F.round(x / length / GRAIN).cast("long"))
    order = W.partitionBy("d1", "d2").orderBy("id", F.xxhash64("v"))
    keyed = rows.distinct().withColumn("d", direction).select("id", "v", "dim", F.xxhash64("d").alias("d1"), F.xxhash64(F.lit("2"), "d").alias("d2"))
    few = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    nodes = durable(few.groupBy("d1", "d2", "dim").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("held")), "nodes")
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("held").cast("long")).alias("rows")).collect()
    counts = {r.dim: shard_count(r.nodes, 8 * r.dim * r.rows) for r in sizes}
    if not counts:
        counts = {0: 1}
    shards = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("dim"))
    dealt = nodes.withColumn("shard", F.pmod("d1", shards).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("d1", "ascending"), ("d2", "ascending")])
        dim = table["dim"][0].as_py()
        held = table["held"].combine_chunks()
        ends = np.cumsum(held.value_lengths().to_numpy())
        each = held.flatten()
        vectors = np.array(each.field("v").flatten().to_numpy(), dtype=np.float64).reshape(-1, dim)
        links, sizes, entry = build(vectors[np.concatenate([[0], ends[:-1]])])
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int64()), "entry": pa.array([entry], pa.int32()),
                "ends": pa.array([ends.astype("<i4").tobytes()], pa.binary()), "ids": pa.array([each.field("id").to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "links": pa.array([[m.tobytes() for m in links]], pa.list_(pa.binary())), "sizes": pa.array([[m.tobytes() for m in sizes]], pa.list_(pa.binary())),
            }
        )

    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard long, entry int, ends binary, ids binary, vectors binary, links array<binary>, sizes array<binary>")


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest found of each query ``(id, v, dim)``: query_id, rank, vec_id, score."""
    index = durable(index, "hnsw")
    asked = durable(queries.distinct().select("id", "v", "dim", F.xxhash64("v").alias("q1"), F.xxhash64(F.lit("2"), "v").alias("q2")), "queries")
    once = asked.groupBy("q1", "q2", "dim").agg(F.first("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("to_shard"))
    dealt = once.join(shards, F.col("dim") == F.col("of_dim")).select("q1", "q2", "v", "dim", F.col("to_shard").alias("shard"), F.pmod("q1", F.lit(blocks)).cast("int").alias("block"))

    def run(key, shard: pa.Table, block: pa.Table) -> pa.Table:
        kinds = {"q1": pa.int64(), "q2": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not shard.num_rows or not block.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        dim, entry = shard["dim"][0].as_py(), shard["entry"][0].as_py()
        ends, ids = np.frombuffer(shard["ends"][0].as_py(), "<i4"), np.frombuffer(shard["ids"][0].as_py(), "<i8")
        begins = np.concatenate([[0], ends[:-1]])
        vectors = np.frombuffer(shard["vectors"][0].as_py(), np.float64).reshape(-1, dim)
        links = [np.frombuffer(x, np.int32).reshape(len(ends), -1) for x in shard["links"][0].as_py()]
        sizes = [np.frombuffer(x, np.int32) for x in shard["sizes"][0].as_py()]
        unit, length = _unit(vectors[begins]), np.sqrt((vectors * vectors).sum(axis=1))
        raw = np.array(block["v"].combine_chunks().flatten().to_numpy(), dtype=np.float64).reshape(block.num_rows, dim)
        out = []
        for row, (v, q) in enumerate(zip(raw, _unit(raw))):
            near = search(unit, links, sizes, entry, q)
            rows = np.concatenate([np.arange(begins[n], ends[n]) for n in near[: 4 * k]])
            score = np.clip((vectors[rows] * v).sum(axis=1) / (length[rows] * np.sqrt((v * v).sum())), -1.0, 1.0)
            best = np.lexsort((ids[rows], -np.round(score, 12)))[: k + 1]  # one of them may be the query's own row
            out.append((np.full(len(best), row), ids[rows][best], score[best]))
        row, found, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"q1": block["q1"].combine_chunks().take(pa.array(row)), "q2": block["q2"].combine_chunks().take(pa.array(row)), "vec_id": pa.array(found), "score": pa.array(score)})

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, "q1 long, q2 long, vec_id long, score double")
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.round("score", 12).desc(), "vec_id"))
    # A vec_id on several rows counts once, by its best score; k + 1 are left of each query vector for the ids that ask.
    found = found.groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score")).withColumn("r", rank("q1", "q2")).where(F.col("r") <= k + 1)
    both = asked.select(F.col("id").alias("query_id"), "q1", "q2").join(found, ["q1", "q2"]).where(F.col("query_id") != F.col("vec_id"))
    pairs = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_hnsw(spark, sf_dir: str) -> DataFrame:
    rows = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")
    return nearest(build_index(rows, 5), rows.where(F.col("id") % 50 == 0), 5)
