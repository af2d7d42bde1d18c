"""Removal of word passages that occur more than once in a corpus.

A window is ``width`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts anywhere else, the same document
included, is removed; windows are judged on the input texts.

Windows are found by exact hash counting (``gramcount``): one scan packs a hash
per window into buckets, each bucket marks hashes met twice or more, and the
marks return to their documents as word spans.  The README says why this
replaces one automaton per shard of the corpus.

Defined cases: null or empty text has no words and stays as it is; texts shorter
than a window lose nothing; equal rows lose all their windows; ids may be null
or repeated (rows are keyed by id and text).  An input column named like a
result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gramcount import FLUSH_BYTES, Flusher, n_buckets, pack_refs, repeats, scan, unpack_refs
from .wordbytes import inside, windows, words
from .workers import freeing, freeing_group

#: Words in a window of the production query.
WIDTH = 35
_HASH_BYTES = 7


def _marks(keyed: DataFrame, width: int) -> DataFrame:
    """``(k1, k2, spans)``: the word spans to remove of every row that has any."""
    size = keyed.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = n_buckets(size // 6)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Flusher(buckets, _HASH_BYTES)
        keys: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        at = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = np.stack([*(np.concatenate([k[i] for k in keys]) for i in (0, 1)), np.concatenate(starts)]).astype(np.int64)
            # Windows met again in this very flush are known to repeat; only the rest need an answer.
            yield from out.cut(lambda _, refs, __: len(table[0]).to_bytes(8, "little") + table.tobytes() + pack_refs(np.sort(refs)))

        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in words(batch.column(2)):
                found = windows(part.hashes(), width)
                ok = np.flatnonzero(inside(part.ptr, width, len(found)))
                out.add(found[ok], ok + at, len(part.data))
                keys.append((k1[part.first : part.last], k2[part.first : part.last]))
                starts.append(part.ptr[:-1] + at)
                at += len(part.starts)
                if out.bytes >= FLUSH_BYTES:
                    yield from flush()
                    keys, starts, at = [], [], 0
        if keys:
            yield from flush()

    def spans(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        refs = [unpack_refs(x) for k, x in zip(kinds, table["refs"].to_pylist()) if k == 0]
        directory = next(x for k, x in zip(kinds, table["hashes"].to_pylist()) if k == 1)
        rows_held = int.from_bytes(directory[:8], "little")
        k1, k2, starts = np.frombuffer(directory, dtype=np.int64, count=3 * rows_held, offset=8).reshape(3, -1)
        hit = np.sort(np.concatenate([*refs, unpack_refs(directory[8 + 24 * rows_held :])]))
        row = np.searchsorted(starts, hit, side="right") - 1
        rows, first = np.unique(row, return_index=True)
        out = []
        for a, b in zip(first, [*first[1:], len(hit)]):
            own = hit[a:b] - starts[row[a]]
            new = np.flatnonzero(np.diff(own, prepend=-width - 1) > width)
            last = np.append(new[1:] - 1, len(own) - 1)
            out.append(np.stack([own[new], own[last] + width], axis=1).astype("<i4").tobytes())
        return pa.table({"k1": pa.array(k1[rows], pa.int64()), "k2": pa.array(k2[rows], pa.int64()), "spans": pa.array(out, pa.binary())})

    found = repeats(scan(keyed.select("k1", "k2", "text"), task), _HASH_BYTES, with_counts=False)
    return found.groupBy("flush").applyInArrow(freeing_group(spans), "k1 long, k2 long, spans binary").groupBy("k1", "k2").agg(F.first("spans").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut out of the text.

    The text keeps its white space around what stays.  Added columns:
    ``n_words`` and ``n_removed`` (long, of the input text) and
    ``removed_spans`` (array of struct ``first``, ``last``: word numbers, the
    last one excluded).
    """
    added = ("n_words", "n_removed", "removed_spans")
    docs = docs.drop(*[c for c in docs.columns if c in added and c not in (id_col, text_col)])
    key = docs[f"`{id_col}`"].cast("string")
    text = docs[f"`{text_col}`"]
    k1, k2 = F.xxhash64(key, text), F.xxhash64(text, F.lit("2"), key)
    marks = _marks(docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")), width)
    own, names = docs.schema.fields, [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    keyed = docs.toDF(*names).withColumns({"k1": F.xxhash64(F.col(names[docs.columns.index(id_col)]).cast("string"), F.col(names[at])), "k2": F.xxhash64(F.col(names[at]), F.lit("2"), F.col(names[docs.columns.index(id_col)]).cast("string"))})
    joined = keyed.join(marks, ["k1", "k2"], "left").select(*names, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at), batch.column(len(names)).to_pylist()
            counts = np.zeros(len(spans), dtype=np.int64)
            removed = np.zeros(len(spans), dtype=np.int64)
            new: list[bytes | None] = texts.cast(pa.binary()).to_pylist()
            lists: list[list[dict]] = [[] for _ in spans]
            for part in words(texts):
                counts[part.first : part.last] = np.diff(part.ptr)
                for row in range(part.first, part.last):
                    if not spans[row]:
                        continue
                    own = np.frombuffer(spans[row], dtype="<i4").reshape(-1, 2)
                    lo, hi = part.ptr[row - part.first], part.ptr[row - part.first + 1]
                    base = part.row_at[row - part.first]
                    edges = np.append(part.starts[lo:hi] - base, part.row_at[row - part.first + 1] - base)
                    keep, pieces, was = new[row], [], 0
                    for a, b in own.tolist():
                        pieces.append(keep[was : edges[a]])
                        was = int(edges[b])
                    new[row] = b"".join([*pieces, keep[was:]])
                    removed[row] = int((own[:, 1] - own[:, 0]).sum())
                    lists[row] = [{"first": a, "last": b} for a, b in own.tolist()]
            columns = [pa.array(new, pa.binary()).cast(pa.large_string()).cast(texts.type) if i == at else batch.column(i) for i in range(len(names))]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(removed), pa.array(lists, kind)], names=[*names, *added])

    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(names, own)]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(span))]
    )
    return joined.mapInArrow(freeing(cut), schema).toDF(*docs.columns, *added)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    kept = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(kept).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS gram FROM p),
r AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT doc_id, i FROM g SEMI JOIN r USING (gram)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM h),
y AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM x GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN words
              ELSE list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(gone, k)), lambda k: words[k]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN y ON w.doc_id IS NOT DISTINCT FROM y.doc_id
"""
