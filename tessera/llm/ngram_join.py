"""N-gram Jaccard self-join with rare-first prefixes.

A document's set is its distinct word n-grams (ASCII-lowered words).  Two
documents link when ``100 * |A & B| >= percent * |A | B|``.

1. One scan hashes every n-gram; exact document frequencies come from
   ``gramcount``.  An n-gram met once can't be shared, so only the others
   return to their documents, ordered rare first (frequency, then hash).
2. Equal sets form a class; one set of each class goes on.
3. A set of ``n`` n-grams has a prefix of ``n - ceil(t * n) + 1``.  Its n-grams
   of frequency 1 fill the prefix first, so most documents have none to join.
4. Prefix n-grams are joined.  Length, positional and suffix filters (the
   suffix split into four hash ranges) bound the overlap of each pair before
   the pair is verified, once, on the whole sets.
5. Pairs come in rounds.  First each set meets a leader of each of its prefix
   n-grams, and the links found form components.  Then only prefix n-grams that
   still meet in different components go on; their sets meet a few other leaders.
   At last the sets of different components meet at each n-gram that is left.  A
   link between sets of one component changes nothing, so the components are
   those of all links, without all pairs of a large group of near copies.  From
   the second round on, the suffix filter is sharper: parity sketches of
   ``_BITS`` bits bound the symmetric difference from below (each differing
   n-gram flips one bit), which never drops a link.
6. In the last round the smaller set of a pair is looked up by the short prefix
   that suffices for it (``n - ceil(2t / (1 + t) * n) + 1``), so sets of one
   template that differ by more than the threshold allows don't meet at its
   n-grams at all.  A pair counts only at its first common n-gram: the filters
   allow for no overlap before it, and a pair is passed over where one of the
   n-grams just before is common too.  The rows of an n-gram that many sets have
   are dealt out in blocks.

Defined cases: null or blank text has an empty set and links with nothing, not
even with another; a text with fewer than ``n`` words is one n-gram; null ids
belong to classes but don't name them unless nothing else can; equal rows link;
other input columns take no part.

N-grams are known by hashes of at least 48 bits (``gramcount`` gives the odds:
about one in 10**6 that any two of a bucket's n-grams that differ are taken for
one in a given pair of documents), equal sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .durable import delete_tables, durable, note_table, noted_tables
from .gramcount import FLUSH_BYTES, Flusher, bucket_of, gram_ids, n_buckets, repeats, scan, unpack_counted, unpack_refs
from .wordbytes import mix64, windows, words
from .workers import freeing, freeing_group

NGRAM, PERCENT = 5, 75
_HASH_BYTES = 6
_RANGES = 4
_BITS = 1024
_LEADERS = 4
#: Rows of one n-gram that a task compares with as many others, at most, in the last round.
_BLOCK = 1024
#: Shared n-grams before each, by which a pair is known to have met already.
_BEFORE = 4
_PREFIX = np.dtype([("h", "<i8"), ("pos", "<i4"), *((f"s{k}", "<i4") for k in range(_RANGES))])


def _row_sets(part, ngram: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct n-gram hashes)`` for every row of a slice."""
    hashes = part.hashes(lower=True)
    grams = windows(hashes, ngram)
    for row in range(part.last - part.first):
        a, b = part.ptr[row], part.ptr[row + 1]
        if b - a >= ngram:
            yield row, np.unique(grams[a : b - ngram + 1])
        elif b > a:
            yield row, mix64(windows(hashes[a:b], int(b - a)) + np.uint64(b - a))[:1]
        else:
            yield row, np.zeros(0, np.uint64)


def _sets(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """One row per document: id, n, class key (c1, c2), and for documents that can have a partner the shared n-grams and the prefix."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = n_buckets(size // 6)
    id_type = docs.schema["id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Flusher(buckets, _HASH_BYTES)
        ids: list[pa.Array] = []
        rows: list[tuple[int, int, int, int]] = []  # n, c1, c2, reference or -1
        known: dict[tuple[int, int], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.table({"id": pa.concat_arrays(ids), **{k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("n", "c1", "c2", "ref"))}})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as to:
                to.write_table(table)

            def directory(hashes: np.ndarray, refs: np.ndarray, sent: np.ndarray) -> bytes:
                stay = ~sent  # they take the answer of the entry that is sent
                grams = gram_ids(hashes[stay], bucket_of(hashes[stay], buckets), _HASH_BYTES)
                return len(grams).to_bytes(8, "little") + grams.tobytes() + refs[stay].astype("<i4").tobytes() + sink.getvalue().to_pybytes()

            yield from out.cut(directory)

        for batch in batches:
            for part in words(batch.column(1)):
                ids.append(batch.column(0).slice(part.first, part.last - part.first))
                found, refs = [], []
                for _, grams in _row_sets(part, ngram):
                    key = (int(grams.sum().view(np.int64)), int(mix64(grams).sum().view(np.int64))) if len(grams) else (0, 0)
                    ref = -1
                    if len(grams) and key not in known:
                        ref = known[key] = len(known)
                        found.append(grams)
                        refs.append(np.full(len(grams), ref, dtype=np.int64))
                    rows.append((len(grams), *key, ref))
                if found:
                    out.add(np.concatenate(found), np.concatenate(refs), len(part.data))
                else:
                    out.bytes += len(part.data)
                if out.bytes >= FLUSH_BYTES or len(rows) >= 50_000:
                    yield from flush()
                    ids, rows, known = [], [], {}
        if rows:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        refs, grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        own = None
        for kind, bucket, ref, blob in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "refs", "hashes"))):
            if kind == 1:
                n = int.from_bytes(blob[:8], "little")
                copy_gram, copy_ref = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i4", n, 8 + 8 * n)
                own = pa.ipc.open_stream(memoryview(blob)[8 + 12 * n :]).read_all()
                continue
            refs.append(unpack_refs(ref))
            found, often = unpack_counted(blob, _HASH_BYTES, bucket)
            grams.append(found), counts.append(often)
        ref, gram, count = map(np.concatenate, (refs, grams, counts))
        if len(copy_gram):
            order = np.argsort(gram)
            at = order[np.searchsorted(gram, copy_gram, sorter=order)]
            ref, gram, count = np.append(ref, copy_ref), np.append(gram, copy_gram), np.append(count, count[at])
        order = np.lexsort((gram, count, ref))
        ref, gram = ref[order], gram[order]
        ns, at = own["n"].to_numpy(), own["ref"].to_numpy()
        lo, hi = np.searchsorted(ref, at, side="left"), np.searchsorted(ref, at, side="right")
        shared: list[bytes | None] = []
        prefix: list[bytes | None] = []
        sketch: list[np.ndarray | None] = []
        for n, r, a, b in zip(ns.tolist(), at.tolist(), lo.tolist(), hi.tolist()):
            need = -(-n * percent // 100)
            if r < 0 or b - a < max(need, 1):
                shared.append(None), prefix.append(None), sketch.append(None)
                continue
            mine = gram[a:b]
            alone = n - (b - a)
            take = (n - need + 1) - alone
            rows = np.zeros(take, dtype=_PREFIX)
            rows["h"], rows["pos"] = mine[:take], alone + np.arange(take)
            part = (mix64(mine.view(np.uint64)) >> np.uint64(62)).astype(np.int64)
            for k in range(_RANGES):
                after = (part == k)[::-1].cumsum()[::-1]
                rows[f"s{k}"] = np.append(after, 0)[1 : take + 1]
            bit = np.bincount((mix64(mine.view(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % _BITS, minlength=_BITS) & 1
            sketch.append(np.packbits(bit.astype(np.uint8)).view("<i8"))
            shared.append(np.sort(mine).tobytes()), prefix.append(rows.tobytes())
        return pa.table({"id": own["id"], "n": own["n"], "c1": own["c1"], "c2": own["c2"], "shared": pa.array(shared, pa.binary()), "prefix": pa.array(prefix, pa.binary()), "sketch": pa.array(sketch, pa.list_(pa.int64()))})

    found = repeats(scan(docs, task), _HASH_BYTES, with_counts=True)
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(k, T.LongType()) for k in ("n", "c1", "c2")), T.StructField("shared", T.BinaryType()), T.StructField("prefix", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return found.groupBy("flush").applyInArrow(freeing_group(settle), schema)


def _unpack_prefix(with_before: bool):
    """A row per shared prefix n-gram of ``(c1, c2, n, prefix)``, on request with the n-grams ``before`` it (at most ``_BEFORE``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = [np.frombuffer(x, dtype=_PREFIX) for x in batch.column(3).to_pylist()]
            times = np.array([len(r) for r in rows], dtype=np.int64)
            flat = np.concatenate(rows) if rows else np.zeros(0, _PREFIX)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(flat), 1 << 17):
                cut = slice(at, at + (1 << 17))
                columns = [pa.array(np.repeat(x, times)[cut]) for x in (c1, c2, n)] + [pa.array(np.ascontiguousarray(flat[k][cut])) for k in _PREFIX.names]
                if with_before:
                    held = np.minimum(place[cut], _BEFORE)
                    ends = np.cumsum(held)
                    where = np.repeat(np.arange(at, at + len(held)) - held, held) + np.arange(ends[-1]) - np.repeat(ends - held, held)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat["h"][where])))
                yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "n", *_PREFIX.names, *(["before"] * with_before)])

    return run


def _prefix_rows(sets: DataFrame, with_before: bool = False) -> DataFrame:
    kinds = "c1 long, c2 long, n long, h long, pos int, " + ", ".join(f"s{k} int" for k in range(_RANGES)) + ", before array<long>" * with_before
    return sets.select("c1", "c2", "n", "prefix").mapInArrow(freeing(_unpack_prefix(with_before)), kinds).withColumn("key", F.struct("c1", "c2"))


def _can_link(percent: int, first: bool = False):
    """The length, positional and suffix filters on rows ``a`` and ``b`` that share a prefix n-gram; ``first``: and none before it."""
    a, b = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    length = (a("n") * percent <= b("n") * 100) & (b("n") * percent <= a("n") * 100)
    need = (a("n") + b("n")) * percent  # overlap * (100 + percent) must reach it
    before = F.lit(1) if first else F.least(a("pos"), b("pos")) + 1
    positional = (before + F.least(a("n") - a("pos"), b("n") - b("pos")) - 1) * (100 + percent) >= need
    suffix = (before + sum((F.least(a(f"s{k}"), b(f"s{k}")) for k in range(_RANGES)), F.lit(0))) * (100 + percent) >= need
    return length & positional & suffix


def _sketches_can_link(percent: int):
    """Whether the sketches of rows ``a`` and ``b`` leave room for a link."""
    a, b = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    apart = a("alone") + b("alone") + sum((F.bit_count(a(f"k{i}").bitwiseXOR(b(f"k{i}"))) for i in range(_BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (a("n") + b("n")) * (100 - percent)


def _to_leaders(rows: DataFrame, salts: list[int], condition, columns: list[str]) -> DataFrame:
    """Distinct pairs of each row's set and the leaders of its n-gram, one leader a salt."""
    ranks = [F.struct(F.xxhash64(F.lit(salt), "key.c1", "key.c2").alias("rank"), *columns) for salt in salts]
    least = rows.groupBy("h").agg(F.array(*map(F.min, ranks)).alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = least.select("h", F.explode(F.array_distinct(F.transform("x", lambda x: x.dropFields("rank")))).alias("x")).select("h", "x.*")
    pairs = rows.alias("a").join(leaders.alias("b"), F.col("a.h") == F.col("b.h")).where((F.col("a.key") != F.col("b.key")) & condition)
    return pairs.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of class keys whose whole sets reach the threshold."""
    rows = sets.select(F.struct("c1", "c2").alias("key"), "n", "shared")
    left = pairs.join(rows.toDF("a", "n_a", "shared_a"), "a")
    both = left.join(rows.toDF("b", "n_b", "shared_b"), "b").select("a", "b", "n_a", "n_b", "shared_a", "shared_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            met = np.array([len(np.intersect1d(np.frombuffer(x.as_py(), "<i8"), np.frombuffer(y.as_py(), "<i8"), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5))], dtype=np.int64)
            keep = pa.array(100 * met >= percent * (n_a + n_b - met))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    key = "struct<c1: long, c2: long>"
    return both.mapInArrow(freeing(verify), f"a {key}, b {key}")


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share an n-gram of ``rows`` where the smaller set is looked up and the filters let them pass, each at its first common n-gram or a few."""
    a, b = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    # 2 * percent * n / (100 + percent), rounded up, is the overlap that a set needs with one of its size at least.
    looked_up = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.bool_or(looked_up).alias("any")).where("any and size > 1")
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    dealt = rows.join(sizes.select("h", blocks.alias("blocks")), "h").withColumn("looked_up", looked_up)
    left = dealt.withColumn("block", F.pmod(F.xxhash64("key.c1"), F.col("blocks")).cast("int"))
    right = dealt.where("looked_up").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    larger = (a("n") > b("n")) | ((a("n") == b("n")) & (a("key") > b("key")))
    apart = (a("label") != b("label")) & larger & _can_link(percent, first=True) & _sketches_can_link(percent)
    met = left.alias("a").join(right.alias("b"), (a("h") == b("h")) & (a("block") == b("block"))).where(apart & ~F.arrays_overlap("a.before", "b.before"))
    return met.select(b("key").alias("a"), a("key").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id`` (the smallest id reachable by links)."""
    spark = docs.sparkSession
    with noted_tables() as scratch:
        rows = durable(_sets(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), ngram, percent), "sets")
        sets = durable(rows.where("prefix is not null").groupBy("c1", "c2", "n").agg(F.first("shared").alias("shared"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "classes")
        labels = _labels(sets, percent)
        classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("first_id"))
        classes = classes.join(labels.select("node.c1", "node.c2", "label"), ["c1", "c2"], "left").withColumn("label", F.coalesce("label", F.struct("c1", "c2")))
        smallest = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
        member = durable(classes.join(smallest, "label").select("c1", "c2", "component_id"), "members")
        documents = durable(rows.select("id", "n", "c1", "c2"), "documents")
        kept = [scratch.pop(), scratch.pop()]
    delete_tables(spark, scratch)  # the result reads but the last two
    for path in kept:
        note_table(path)
    out = documents.join(member, ["c1", "c2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _labels(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, label)``: the component of every set that has a link, by class keys."""
    prefix = durable(_prefix_rows(sets).drop("c1", "c2"), "prefix")
    slim = ["key", "n", "pos", *(f"s{k}" for k in range(_RANGES))]
    links = durable(_verified(_to_leaders(prefix, [0], _can_link(percent), slim), sets, percent), "links")
    labels = durable(connected_components(links), "labels")
    bits = [f"k{i}" for i in range(_BITS // 64)]
    sketches = sets.select(F.struct("c1", "c2").alias("key"), (F.col("n") - F.octet_length("shared") / 8).cast("int").alias("alone"), *[F.get("sketch", F.lit(i)).alias(k) for i, k in enumerate(bits)])
    apart = _can_link(percent) & (F.col("a.label") != F.col("b.label")) & _sketches_can_link(percent)

    def unsettled(rows: DataFrame, *more: str) -> DataFrame:
        """The rows of n-grams that meet in several components."""
        own = rows.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")).select("h", "label", *slim, *more)
        mixed = own.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("h")
        return durable(own.join(mixed, "h", "left_semi").join(sketches, "key").select("h", "label", *slim, *more, "alone", *bits), "mixed")

    def join_in(pairs: DataFrame) -> None:
        """Verify pairs and let the links join components."""
        nonlocal labels
        found = durable(_verified(pairs, sets, percent), "links")
        if found.isEmpty():
            return
        label = lambda side: F.coalesce(F.col(f"{side}_label"), F.col(side)).alias(side)
        known = {side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")) for side in "ab"}
        joined = connected_components(found.join(known["a"], "a", "left").join(known["b"], "b", "left").select(label("a"), label("b")))
        joined = durable(joined.select(F.col("node").alias("was"), F.col("label").alias("now")), "joined")
        moved = labels.join(joined, labels["label"] == joined["was"], "left").select("node", F.coalesce("now", "label").alias("label"))
        added = joined.join(labels.select("node"), joined["was"] == labels["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
        labels = durable(moved.unionAll(added), "labels")

    join_in(_to_leaders(unsettled(prefix), list(range(1, 1 + _LEADERS)), apart, ["label", *slim, "alone", *bits]))
    join_in(_meetings(unsettled(_prefix_rows(sets, with_before=True), "before"), percent))
    return labels


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""
