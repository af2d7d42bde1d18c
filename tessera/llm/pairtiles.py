"""Exact counts of 64-bit keys and of adjacent pairs of ids, gathered in tasks and merged in buckets.

A pair of ids below 2 ** 31 is the key ``a << 32 | b``.  Where ids are ranks by
frequency, the pairs of the ``HEAD`` first ids fall into few square tiles of
``SIDE`` by ``SIDE`` cells: a tile with many pairs is counted by one dense
``bincount`` over its cells, all other pairs as sorted coordinates (COO).

A task gathers ``FLUSH_KEYS`` keys, counts them, and sends distinct keys with
their counts to hash buckets as binary blobs; each bucket merges what it gets.
A bucket is chosen by a hash of the key, so a frequent key costs its bucket one
entry per flush, and a bucket holds about ``BUCKET_KEYS`` entries whatever the
size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import mix64
from .workers import freeing, freeing_group

SIDE, HEAD, DENSE_PAIRS = 256, 4096, 8192
FLUSH_KEYS = 1 << 19
BUCKET_KEYS = 256 << 10

BLOBS = "bucket long, keys binary, n binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def run_counts(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each is met (or the sum of its ``n``)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(edges, append=len(keys)) if n is None else np.add.reduceat(n, edges)
    return keys[edges], sums.astype(np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def tile_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids and their counts: dense tiles where pairs are many, sorted coordinates elsewhere."""
    a, b = keys >> 32, keys & 0xFFFFFFFF
    head = np.flatnonzero((a < HEAD) & (b < HEAD))
    tile = ((a[head] // SIDE) * (HEAD // SIDE) + b[head] // SIDE).astype(np.uint16)
    full = np.bincount(tile, minlength=(HEAD // SIDE) ** 2) >= DENSE_PAIRS
    dense = full[tile]
    sparse = np.ones(len(keys), dtype=bool)
    sparse[head[dense]] = False
    out = [run_counts(keys[sparse])]
    tile, at = tile[dense], head[dense]
    order = np.argsort(tile, kind="stable")
    tile, at = tile[order], at[order]
    edges = np.flatnonzero(np.diff(tile.astype(np.int64), prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(tile)]):
        own = keys[at[lo:hi]]
        cells = np.bincount((own >> 32) % SIDE * SIDE + own % SIDE, minlength=SIDE * SIDE)
        met = np.flatnonzero(cells)
        a0, b0 = divmod(int(tile[lo]), HEAD // SIDE)
        out.append((pair_keys(a0 * SIDE + met // SIDE, b0 * SIDE + met % SIDE), cells[met].astype(np.int64)))
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def blobs(keys: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys and counts as one row per bucket, ascending keys within it if they come so."""
    order = np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")
    keys, n, bucket = keys[order], n[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*edges[1:], len(bucket)]
    for at in range(0, len(edges), 256):
        spans = list(zip(edges[at : at + 256], ends[at : at + 256]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[at : at + 256]], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())],
            schema=_SCHEMA,
        )


class Gather:
    """Keys of one task, counted and cut into blobs."""

    def __init__(self, buckets: int, count: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = run_counts, most: int = FLUSH_KEYS) -> None:
        self.buckets, self.count, self.most = buckets, count, most
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.held += len(keys)
        if self.held >= self.most:
            yield from self.cut()

    def cut(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, n = self.count(np.concatenate(self.keys))
            self.keys, self.held = [], 0
            yield from blobs(keys, n, bucket_of(keys, self.buckets))


def n_buckets(keys: int) -> int:
    return max(1, -(-keys // BUCKET_KEYS))


def merged(sent: DataFrame, least: int = 1, as_rows: bool = False) -> DataFrame:
    """The distinct keys with a total of ``least`` or more, and the totals: one row per bucket, ascending, or ``(key, n)`` rows.

    Rows come from the merging task itself: a second Python step in its stage
    would be a second worker for each core.
    """

    def total(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, n = run_counts(*(np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("keys", "n")))
        return keys[n >= least], n[n >= least]

    def blob(table: pa.Table) -> pa.Table:
        keys, n = total(table)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    def rows(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("key", "n"), map(pa.array, total(table)))))

    groups = sent.groupBy("bucket")
    return groups.applyInArrow(freeing_group(rows), "key long, n long") if as_rows else groups.applyInArrow(freeing_group(blob), BLOBS)


def pairs_in(ids: np.ndarray) -> np.ndarray:
    """Keys of the adjacent pairs of a sequence; a negative id ends a run."""
    ok = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return pair_keys(ids[ok], ids[ok + 1])


def _read_first(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(blob, np.int32) for blob in batch.column(0).to_pylist())


def count_pairs(sequences: DataFrame, least: int, column: str = "ids", read: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _read_first, most: int = FLUSH_KEYS, as_rows: bool = False) -> DataFrame:
    """Adjacent pairs met ``least`` times or more in sequences of ids, as ``merged`` gives them.

    ``read`` takes the sequences from a batch; ``column`` has about four bytes for each id; ``most`` keys are gathered.
    """
    size = sequences.select(F.sum(F.octet_length(column))).first()[0] or 0
    buckets = n_buckets(size // 4)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(buckets, tile_counts, most)
        for batch in batches:
            for ids in read(batch):
                yield from gather.add(pairs_in(ids))
        yield from gather.cut()

    return merged(sequences.mapInArrow(freeing(task), BLOBS), least, as_rows)
