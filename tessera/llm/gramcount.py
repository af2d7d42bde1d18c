"""Exact repeat counting of word n-grams without a row per n-gram.

Every scan task packs the hashes of its n-grams into binary blobs, one per hash
bucket.  A hash is sent once per flush (a bounded run of rows of one task), with
its number there if it is met again; the other references stay behind in the
flush's directory.  Blobs are shuffled by bucket, each bucket finds the hashes
met more than once, and the references of those travel back to their flush.  A
bucket holds about ``BUCKET_ITEMS`` hashes whatever the corpus size, and a hot
n-gram costs it one entry per flush, not one per occurrence.

Within a bucket a hash is known by its low ``width`` bytes.  With ``b`` buckets
that tells n-grams apart as a hash of ``8 * width + log2(b)`` bits does (64 at
most): two of ``n`` n-grams are taken for one with a chance of about
``n * n / 2`` over two to that power.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from .durable import text_batches
from .workers import freeing, freeing_group

#: Hashes per bucket aimed at, and bytes of text gathered before blobs are cut.
BUCKET_ITEMS = 256 << 10
FLUSH_BYTES = 6 << 20

BLOBS = pa.schema(
    [("bucket", pa.int64()), ("flush", pa.int64()), ("kind", pa.int8()), ("refs", pa.binary()), ("hashes", pa.binary()), ("often", pa.binary())]
)
BLOBS_DDL = "bucket long, flush long, kind byte, refs binary, hashes binary, often binary"


def pack_refs(refs: np.ndarray) -> bytes:
    """Ascending references as differences in the narrowest of three widths."""
    if not len(refs):
        return b""
    steps = np.diff(refs.astype(np.int64), prepend=0)
    top = int(steps.max())
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpack_refs(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]]
    return np.cumsum(np.frombuffer(blob, dtype=kind, offset=1).astype(np.int64))


def pack_hashes(hashes: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_hashes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def gram_ids(hashes: np.ndarray, buckets, width: int) -> np.ndarray:
    """What an n-gram is known by outside its bucket: the bucket (modulo what fits) above the low bytes of the hash."""
    low = hashes & np.uint64((1 << (8 * width)) - 1)
    return (low | (np.asarray(buckets, dtype=np.uint64) << np.uint64(8 * width))).view("<i8")


def unpack_counted(blob: bytes, width: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and frequency codes of one blob of ``repeats``."""
    n = len(blob) // (width + 1)
    return gram_ids(unpack_hashes(blob[: n * width], width), bucket, width), np.frombuffer(blob, dtype=np.uint8, offset=n * width)


def frequency_code(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with a count (from 2) up to 2 ** 31, in eighths of an octave."""
    return np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


class Flusher:
    """Collects ``(hash, ref)`` of one task and cuts them into blobs by bucket."""

    def __init__(self, buckets: int, width: int) -> None:
        self.buckets, self.width = buckets, width
        self.serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        self.hashes: list[np.ndarray] = []
        self.refs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, hashes: np.ndarray, refs: np.ndarray, size: int) -> None:
        self.hashes.append(hashes)
        self.refs.append(refs)
        self.bytes += size

    def cut(self, directory: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
        """The blobs gathered so far, and a row that carries the directory of the flush.

        ``directory`` gets the hashes and references of the entries whose hash is
        met again in this flush, side by side, and marks of those that are sent.
        """
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        refs = np.concatenate(self.refs) if self.refs else np.zeros(0, np.int64)
        flush, self.serial = self.serial, self.serial + 1
        self.hashes, self.refs, self.bytes = [], [], 0
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        lead = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1])) if len(ranked) else np.zeros(0, np.int64)
        times = np.diff(lead, append=len(ranked))
        sent = np.zeros(len(ranked), dtype=bool)
        sent[lead] = True
        again = np.repeat(times > 1, times)
        body = directory(ranked[again], refs[order[again]], sent[again])
        own = np.sort(order[lead])
        met = np.zeros(len(ranked), dtype=np.uint32)
        met[order[lead]] = times
        hashes, refs, met = hashes[own], refs[own], met[own]
        bucket = bucket_of(hashes, self.buckets)
        if self.buckets <= 1 << 16:
            bucket = bucket.astype(np.uint16)  # sorted faster
        order = np.argsort(bucket, kind="stable")
        bucket, hashes, refs, met = bucket[order], hashes[order], refs[order], met[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(0, np.int64)
        rows = [(int(bucket[a]), 0, pack_refs(refs[a:b]), pack_hashes(hashes[a:b], self.width), _pack_often(met[a:b])) for a, b in zip(edges[:-1], edges[1:])]
        rows.append((flush * 2654435761 % self.buckets, 1, b"", body, b""))
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([flush] * len(part), pa.int64()),
                    pa.array([r[1] for r in part], pa.int8()),
                    *(pa.array([r[i] for r in part], pa.binary()) for i in (2, 3, 4)),
                ],
                schema=BLOBS,
            )


def _pack_often(met: np.ndarray) -> bytes:
    """Places and counts of the hashes met more than once in the flush."""
    at = np.flatnonzero(met > 1)
    return np.concatenate([at, met[at]]).astype("<u4").tobytes()


def _unpack_often(blob: bytes, n: int) -> np.ndarray:
    met = np.ones(n, dtype=np.int64)
    at, times = np.frombuffer(blob, dtype="<u4").reshape(2, -1)
    met[at] = times
    return met


def n_buckets(items: int) -> int:
    return max(1, -(-items // BUCKET_ITEMS))


def repeats(blobs: DataFrame, width: int, with_counts: bool) -> DataFrame:
    """References whose hash is met at least twice, by flush, and the directories.

    With counts, ``hashes`` holds the low bytes of each reference's hash, then a
    byte each that grows with how often it is met (``frequency_code``);
    ``unpack_counted`` reads it.  Without, it is empty, and references whose
    hash their own flush has twice are left out: the flush knows of them.
    """

    def find(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        flushes = table["flush"].to_numpy()
        refs = [unpack_refs(x) for x in table["refs"].to_pylist()]
        raw = table["hashes"].to_pylist()
        hashes = [unpack_hashes(x, width) if k == 0 else np.zeros(0, np.uint64) for k, x in zip(kinds, raw)]
        met = [_unpack_often(x, len(h)) for x, h in zip(table["often"].to_pylist(), hashes)]
        every, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, met))
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        edges = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1])) if len(ranked) else np.zeros(0, np.int64)
        count = np.empty(len(every), dtype=np.int64)
        if len(every):
            count[order] = np.repeat(np.add.reduceat(times[order], edges), np.diff(edges, append=len(ranked)))
        out_flush, out_kind, out_refs, out_hashes = [], [], [], []
        at = 0
        for flush, kind, ref, own, mine, blob in zip(flushes, kinds, refs, hashes, met, raw):
            if kind == 1:
                out_flush.append(flush), out_kind.append(1), out_refs.append(b""), out_hashes.append(blob)
                continue
            own_count = count[at : at + len(own)]
            at += len(own)
            hit = own_count > (1 if with_counts else mine)
            if not with_counts:
                hit &= mine == 1
            if hit.any():
                out_flush.append(flush), out_kind.append(0), out_refs.append(pack_refs(ref[hit]))
                out_hashes.append(pack_hashes(own[hit], width) + frequency_code(own_count[hit]).tobytes() if with_counts else b"")
        return pa.table(
            {
                "bucket": pa.array([table["bucket"][0].as_py()] * len(out_flush), pa.int64()),
                "flush": pa.array(out_flush, pa.int64()),
                "kind": pa.array(out_kind, pa.int8()),
                "refs": pa.array(out_refs, pa.binary()),
                "hashes": pa.array(out_hashes, pa.binary()),
            }
        )

    return blobs.groupBy("bucket").applyInArrow(freeing_group(find), "bucket long, flush long, kind byte, refs binary, hashes binary")


def scan(docs: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.mapInArrow(freeing(task), BLOBS_DDL)
