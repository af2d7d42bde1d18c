"""Best-fit packing of documents into sequences of several permitted lengths.

A document's size is its number of words (or a size column).  Documents longer
than the largest length are cut into pieces of that length and a rest.  Pieces
are dealt by hash to shards of about ``SHARD_ITEMS``; each shard packs its
pieces largest first.  A piece goes to the open bin with the least room that
still holds it; if none does, the permitted lengths compete: for each, the
pieces left are filled in (the largest that fits, again and again), and the
length of least cost per word held is opened.  A bin costs the permitted length
its contents need plus ``BIN_COST``; of equals the shorter wins.  At the end
every bin is downsized to the shortest permitted length that holds its contents.

Shards are of bounded size at any scale and no shard waits for another; the
price is one partly filled bin or two per shard, which downsizing mostly
recovers.

Sizes are counted once, in a table of ids and sizes.  Pieces are dealt by id, size
and place in that table, so repeated or null ids are spread like others.

Defined cases: null or empty text (size 0) gives one row without a bin; equal
rows are packed each; sizes are never cut off except into pieces; an empty table
gives an empty result; an input column named like a result column is replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .mixing import word_count

LENGTHS = (256, 512, 1024, 2048, 4096)
SHARD_ITEMS = 4096
BIN_COST = 32


def _held(room: int, sizes: list[int], left: dict[int, int]) -> int:
    """Words that the pieces left put into ``room``, the largest that fits first; ``sizes`` ascend."""
    held, at = 0, bisect.bisect_right(sizes, room) - 1
    while at >= 0 and room > 0:
        size = sizes[at]
        n = min(left[size], room // size)
        held, room = held + n * size, room - n * size
        at = min(at, bisect.bisect_right(sizes, room)) - 1
    return held


def open_size(size: int, sizes: list[int], left: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> int:
    """The permitted length of least cost per word held, opened for a piece of ``size`` when ``left`` counts the other pieces by size."""

    def cost(c: int) -> tuple[float, int]:
        held = size + _held(c - size, sizes, left)
        return (lengths[bisect.bisect_left(lengths, held)] + BIN_COST) / held, c

    return min((c for c in lengths if c >= size), key=cost)


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and the bin's final length of each piece (in the order given: largest first)."""
    room: list[int] = []  # ascending, with the bins beside it
    bins: list[int] = []
    used: list[int] = []
    where, offset = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
    kinds, counts = np.unique(sizes, return_counts=True)
    left = dict(zip(kinds.tolist(), counts.tolist()))
    kinds = kinds.tolist()
    for i, size in enumerate(sizes.tolist()):
        left[size] -= 1
        if not left[size]:
            del left[size]
            kinds.pop(bisect.bisect_left(kinds, size))
        at = bisect.bisect_left(room, size)
        if at < len(room):
            free, b = room.pop(at), bins.pop(at)
        else:
            free, b = open_size(size, kinds, left, lengths), len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += size
        if free > size:
            at = bisect.bisect_right(room, free - size)
            room.insert(at, free - size)
            bins.insert(at, b)
    final = np.array([lengths[bisect.bisect_left(lengths, u)] for u in used], dtype=np.int32)
    return where, offset, final[where] if len(sizes) else np.zeros(0, np.int32)


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece: id, ``piece``, ``n_tokens``, ``bin_id``, ``bin_capacity``, ``bin_offset``.

    ``bin_id`` is text (shard and number); null, like the last two, for a
    document without words.
    """
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    size = docs[f"`{size_col}`"].cast("long") if size_col else word_count(docs[f"`{text_col}`"])
    sized = durable(docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(size, F.lit(0)).alias("size")), "sizes").withColumn("place", F.monotonically_increasing_id())
    total = sized.agg(F.sum(F.greatest(F.ceil(F.col("size") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_ITEMS))
    last = F.greatest(F.ceil(F.col("size") / top), F.lit(1)) - 1
    pieces = sized.select("id", "size", "place", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece")).select(
        "id", "piece", "place", F.least(F.col("size") - F.col("piece").cast("long") * top, F.lit(top)).cast("int").alias("n_tokens")
    )
    full = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), "n_tokens", "place", "piece"), F.lit(shards)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending"), ("place", "ascending")])
        where, offset, final = pack(table["n_tokens"].to_numpy(), lengths)
        out = table.select(["id", "piece", "n_tokens", "shard"])
        for name, values in (("bin", where), ("bin_capacity", final), ("bin_offset", offset)):
            out = out.append_column(name, pa.array(values, pa.int32()))
        return out

    packed = full.groupBy("shard").applyInArrow(run, f"id {id_type}, piece int, n_tokens int, shard long, bin int, bin_capacity int, bin_offset int")
    packed = packed.select("id", "piece", "n_tokens", F.concat_ws("-", "shard", "bin").alias("bin_id"), "bin_capacity", "bin_offset")
    empty = pieces.where("n_tokens <= 0").select("id", "piece", "n_tokens", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_capacity"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionAll(empty).withColumnRenamed("id", id_col)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
