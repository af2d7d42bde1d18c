"""Removal of passages that occur in a reference, by broadcast suffix automata.

The reference is cut into shards of at most ``SHARD_WORDS`` words that overlap by
a window less one word, so every window of the reference lies in a shard.  The
shards' word hashes are broadcast, every task builds the suffix automata from
them (about 20 MB of Python objects a shard of 50,000 words), and documents are
streamed through each of them for matching statistics (the longest suffix of
what has been read that occurs in the shard), and every maximal span whose match
reaches ``width`` words is removed.

A broadcast is made only for a reference of at most ``MAX_WORDS`` words, which is
counted first; a larger one is refused (``substring_dedup`` deduplicates a corpus
against itself).

Defined cases: null or empty reference and document texts match nothing; equal
rows are treated alike; a shorter reference text than a window matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import word_count
from .wordbytes import words

SHARD_WORDS, MAX_WORDS = 50_000, 2_000_000


def automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the suffix automaton of a sequence."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({}), link.append(0), longest.append(longest[last] + 1)
        at = last
        while at >= 0 and s not in step[at]:
            step[at][s] = new
            at = link[at]
        if at >= 0:
            to = step[at][s]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to])), link.append(link[to]), longest.append(longest[at] + 1)
                while at >= 0 and step[at].get(s) == to:
                    step[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step, link, longest


def matching(symbols: list[int], built) -> list[int]:
    """For each place, the length of the longest suffix read so far that occurs in the automaton's sequence."""
    step, link, longest = built
    at = length = 0
    out = []
    for s in symbols:
        while at and s not in step[at]:
            at = link[at]
            length = longest[at]
        to = step[at].get(s)
        if to is None:
            length = 0
        else:
            at, length = to, length + 1
        out.append(length)
    return out


def covered(matches: list[int], width: int) -> np.ndarray:
    """True for every word of a match of at least ``width`` words."""
    long = np.flatnonzero(np.asarray(matches) >= width)
    edge = np.zeros(len(matches) + 1, dtype=np.int64)
    np.add.at(edge, long - width + 1, 1)
    np.add.at(edge, long + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Word-hash sequences of the reference, at most a shard's words each, as binary."""
    held: list[np.ndarray] = []
    size = 0

    def cut() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<u8").tobytes()], pa.binary())], names=["shard"])

    for batch in batches:
        for part in words(batch.column(0)):
            h = part.hashes()
            for row in range(part.last - part.first):
                own = h[part.ptr[row] : part.ptr[row + 1]]
                for at in range(0, max(len(own) - width + 1, 0), SHARD_WORDS - width):
                    piece = own[at : at + SHARD_WORDS]
                    if size and size + len(piece) > SHARD_WORDS:
                        yield cut()
                        held, size = [], 0
                    # A symbol no word has keeps matches from running across pieces.
                    held.append(np.append(piece, np.uint64(len(held))))
                    size += len(piece) + 1
    if held:
        yield cut()


def remove_reference_passages(docs: DataFrame, reference: DataFrame, width: int, text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """``docs`` with text without passages of the reference, and ``n_removed`` words."""
    spark = docs.sparkSession
    total = reference.select(F.sum(word_count(reference[f"`{reference_col}`"]))).first()[0] or 0
    if total > MAX_WORDS:
        raise ValueError(f"a reference of {total} words is too large to broadcast; the bound is {MAX_WORDS}")
    cutter = reference.select(reference[f"`{reference_col}`"].alias("t")).mapInArrow(lambda it: _shards(it, width), "shard binary")
    shared = spark.sparkContext.broadcast([r.shard for r in cutter.collect()])  # at most MAX_WORDS and the overlaps, 8 bytes each
    at = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if c != "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [automaton(np.frombuffer(x, "<u8").tolist()) for x in shared.value]
        for batch in batches:
            texts: list[bytes | None] = batch.column(at).cast(pa.binary()).to_pylist()
            removed = np.zeros(batch.num_rows, dtype=np.int64)
            for part in words(batch.column(at)):
                h = part.hashes()
                for row in range(part.first, part.last):
                    a, b = part.ptr[row - part.first], part.ptr[row - part.first + 1]
                    own = h[a:b].tolist()
                    gone = np.zeros(len(own), dtype=bool)
                    for one in built:
                        gone |= covered(matching(own, one), width)
                    removed[row] = gone.sum()
                    if not removed[row]:
                        continue
                    base = part.row_at[row - part.first]
                    edges = np.append(part.starts[a:b] - base, len(texts[row]))
                    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    pieces, was = [], 0
                    for x, y in turn.reshape(-1, 2).tolist():
                        pieces.append(texts[row][was : edges[x]])
                        was = int(edges[y])
                    texts[row] = b"".join([*pieces, texts[row][was:]])
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(new if i == at else batch.column(i) for i in keep), pa.array(removed)], names=[*(f"c{i}" for i in keep), "n_removed"])

    schema = T.StructType([*(T.StructField(f"c{i}", docs.schema[i].dataType) for i in keep), T.StructField("n_removed", T.LongType())])
    return docs.mapInArrow(run, schema).toDF(*(docs.columns[i] for i in keep), "n_removed")
