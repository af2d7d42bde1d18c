"""Source divergence audit: which sources of a language use its words differently.

Terms are runs of ASCII letters and of characters beyond ASCII, with only A-Z
lower-cased.  Each language keeps the terms that at least ``least`` of its
documents have.  With a term's ``count`` in a (language, source) group or in the
language, ``p = 1 + floor(1e9 * (count + 2) / (N + 2 * V))``, where ``N`` sums
the counts of kept terms there and ``V`` is the number of kept terms; two values
of ``p`` differ by ``floor((p - q) ** 2 / (p + q))``.

Counting packs terms by length: up to 8 bytes make one unsigned word, up to 16
two, which are radix-sorted (16 bits a pass) and run-counted with numpy; longer
terms go to one bucket per power of two of their length, sorted as bytes.  A task
counts a slice of about 6 MB of text, by term and source, and sends what it
found to hash buckets of terms; a bucket merges the slices, drops terms of too
few documents and keeps a sparse table of term and source.  Each of these tables
then meets the groups of its language (one list per language, as long as the
report has rows for a source) and yields its part of every sum and its own
first terms.  No vocabulary is broadcast or collected.

Defined cases: null text, language and source are ``''``; a group or a language
without kept terms has differences of 0; ids take no part; repeated rows count
each; an empty table gives an empty result.  ``N + 2 * V`` must stay below 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .durable import durable, text_batches
from .wordbytes import Words, _tables, letter_bytes, mix64, words

LEAST, TOP = 10, 10
BUCKET_ENTRIES = 1 << 20
SLICE_BYTES = 6 << 20
#: Cells of a dense table of terms and sources held at once.
_CELLS = 1 << 20

_SENT = "lang string, width int, bucket long, terms binary, docs binary, groups binary, source binary, n binary, sources array<string>"
_KEPT = "lang string, width int, bucket long, v long, terms binary, term binary, source binary, n binary, sources array<string>, totals array<long>"


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Byte spans as rows of big-endian 64-bit words, padded with zero bytes: their order is that of the bytes."""
    length = ends - starts
    out = np.zeros(len(starts) * width, dtype=np.uint8)
    ahead = np.cumsum(length) - length
    out[np.arange(length.sum()) + np.repeat(np.arange(len(starts)) * width - ahead, length)] = data[_ranges(starts, length)]
    return out.view(">u8").astype(np.uint64).reshape(-1, width // 8)


def radix_order(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` sorted by unsigned columns, the first counts most: 16 bits a pass, stable."""
    for column in reversed(columns):
        top = int(column.max()) if len(column) else 0
        for shift in range(0, max(top.bit_length(), 1), 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)[order]
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit, kind="stable")]
    return order


def term_order(terms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` sorted by packed terms: by radix up to two words, as bytes beyond."""
    if terms.shape[1] <= 2:
        return radix_order(list(terms.T), order)
    text = np.ascontiguousarray(terms.astype(">u8")).view(f"S{8 * terms.shape[1]}").reshape(-1)
    return order[np.argsort(text[order], kind="stable")]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where any column differs from the row before."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            different = c[1:] != c[:-1]
            new[1:] |= different if different.ndim == 1 else different.any(axis=1)
    return new


def _bucket(terms: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(terms), dtype=np.uint64)
    for column in terms.T:
        h = mix64(h ^ mix64(column))
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _widths(length: np.ndarray) -> np.ndarray:
    """8, 16, 32, 64 and so on: the least that holds each length."""
    return 1 << np.maximum(3, np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))


def _count_slice(part: Words, langs: np.ndarray, sources: np.ndarray, lang_names: list[str], source_names: list[str], buckets: int) -> Iterator[tuple]:
    """The rows of ``_SENT`` of one slice."""
    data = _tables()[1][part.data]
    row_of = np.repeat(np.arange(part.last - part.first), np.diff(part.ptr))
    width_of = _widths(part.ends - part.starts)
    for width in np.unique(width_of).tolist():
        at = np.flatnonzero(width_of == width)
        terms = packed(data, part.starts[at], part.ends[at], width)
        row = row_of[at]
        lang, source = langs[part.first : part.last][row], sources[part.first : part.last][row]
        order = radix_order([source], np.arange(len(at)))
        order = radix_order([lang], term_order(terms, order))
        terms, row, lang, source = terms[order], row[order], lang[order], source[order]
        new_term = _changes(lang, terms)
        new_group = new_term | _changes(source)
        new_row = new_group | _changes(row)
        first, group = np.flatnonzero(new_term), np.flatnonzero(new_group)
        docs = np.add.reduceat(new_row.astype(np.int64), first)
        groups = np.add.reduceat(new_group.astype(np.int64), first)
        n, source = np.diff(group, append=len(terms)), source[group]
        terms, lang = terms[first], lang[first]
        bucket = _bucket(terms, buckets)
        place = np.cumsum(groups) - groups
        order = radix_order([lang, bucket.astype(np.uint32)], np.arange(len(terms)))
        edges = np.flatnonzero(_changes(lang[order], bucket[order]))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            own = order[lo:hi]
            entries = _ranges(place[own], groups[own])
            used, code = np.unique(source[entries], return_inverse=True)
            yield (
                lang_names[lang[own[0]]], width, int(bucket[own[0]]), terms[own].astype(">u8").tobytes(), docs[own].astype("<i8").tobytes(),
                groups[own].astype("<u4").tobytes(), code.astype("<u4").tobytes(), n[entries].astype("<i8").tobytes(), [source_names[u] for u in used],
            )


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _counted(docs: DataFrame, least: int) -> DataFrame:
    """Kept terms and their counts by source, in hash buckets."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-(size // 8) // BUCKET_ENTRIES))
    schema = pa.schema(
        [("lang", pa.string()), ("width", pa.int32()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("terms", "docs", "groups", "source", "n")), ("sources", pa.list_(pa.string()))]
    )

    def coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
        d = column.cast(pa.string()).dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.uint32), d.dictionary.to_pylist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (langs, lang_names), (sources, source_names) = coded(batch.column(0)), coded(batch.column(1))
            for part in words(batch.column(2), SLICE_BYTES, letter_bytes()):
                rows = []
                for row in _count_slice(part, langs, sources, lang_names, source_names, buckets):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        width = table["width"][0].as_py()
        names = sorted({s for own in table["sources"].to_pylist() for s in own}, key=str.encode)
        code_of = {s: i for i, s in enumerate(names)}
        joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        terms = joined("terms", ">u8").astype(np.uint64).reshape(-1, width // 8)
        docs, groups, n = joined("docs", "<i8"), joined("groups", "<u4").astype(np.int64), joined("n", "<i8")
        source = np.concatenate([np.array([code_of[s] for s in own], dtype=np.int64)[np.frombuffer(c, "<u4")] for own, c in zip(table["sources"].to_pylist(), table["source"].to_pylist())])
        order = term_order(terms, np.arange(len(terms)))
        new = _changes(terms[order])
        first = np.flatnonzero(new)
        number = np.empty(len(terms), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        kept = np.add.reduceat(docs[order], first) >= least
        code = np.where(kept, np.cumsum(kept) - 1, -1)
        entry = code[np.repeat(number, groups)]
        entry, source, n = entry[entry >= 0], source[np.repeat(kept[number], groups)], n[np.repeat(kept[number], groups)]
        order = radix_order([entry.astype(np.uint32), source.astype(np.uint32)], np.arange(len(entry)))
        entry, source, n = entry[order], source[order], n[order]
        at = np.flatnonzero(_changes(entry, source))
        n = np.add.reduceat(n, at) if len(at) else n
        entry, source = entry[at], source[at]
        totals = np.zeros(len(names), dtype=np.int64)
        np.add.at(totals, source, n)
        v = int(kept.sum())
        out = (
            table["lang"][0].as_py(), width, table["bucket"][0].as_py(), v, terms[np.unique(number, return_index=True)[1]][kept].astype(">u8").tobytes(),
            entry.astype("<u4").tobytes(), source.astype("<u4").tobytes(), n.astype("<i8").tobytes(), names, totals.tolist(),
        )
        kinds = pa.schema([("lang", pa.string()), ("width", pa.int32()), ("bucket", pa.int64()), ("v", pa.int64()), *((c, pa.binary()) for c in ("terms", "term", "source", "n")), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])
        return pa.Table.from_arrays([pa.array([x] if v else [], t.type) for x, t in zip(out, kinds)], schema=kinds)

    return durable(docs.mapInArrow(task, _SENT).groupBy("lang", "width", "bucket").applyInArrow(merge, _KEPT), "terms")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(1e9 * count / total)``, exactly, in three steps that stay within 64 bits."""
    out, rest = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), count + np.zeros_like(total)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _scored(tables: DataFrame, top: int) -> DataFrame:
    """Per bucket: its part of each pair's sum, and its first terms of each source."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                names, total = [g["source"] for g in x["groups"]], np.array([g["total"] for g in x["groups"]], dtype=np.int64)
                code_of = {s: i for i, s in enumerate(names)}
                code = np.array([code_of[s] for s in x["sources"]], dtype=np.int64)[np.frombuffer(x["source"], "<u4")]
                term, n = np.frombuffer(x["term"], "<u4").astype(np.int64), np.frombuffer(x["n"], "<i8")
                terms = np.frombuffer(x["terms"], f"S{x['width']}")
                sums = np.zeros((len(names), len(names)), dtype=np.int64)
                found = []
                step = max(1, _CELLS // len(names))
                for lo in range(0, len(terms), step):
                    hi = min(lo + step, len(terms))
                    a, b = np.searchsorted(term, [lo, hi])
                    count = np.zeros((hi - lo, len(names)), dtype=np.int64)
                    count[term[a:b] - lo, code[a:b]] = n[a:b]
                    p = share(count + 2, total + 2 * x["all"])
                    q = share(count.sum(axis=1) + 2, np.full(hi - lo, total.sum() + 2 * x["all"]))
                    for i in range(len(names)):
                        sums[i, i + 1 :] += difference(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
                        more = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                        value = difference(p[more, i], q[more])
                        best = np.argsort(-value, kind="stable")[:top]
                        found += [(names[i], "term", terms[lo + more[k]].decode(), int(value[k])) for k in best]
                pairs = [(names[i], "pair", names[j], int(sums[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
                for at in range(0, len(both := found + pairs), 65536):
                    rows = [(x["lang"], *r) for r in both[at : at + 65536]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    return tables.mapInArrow(task, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language (``pair``), and the ``top`` terms that the source has more of (``term``)."""
    text_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(""))
    docs = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    tables = _counted(docs, least)
    per = tables.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.totals").alias("total"))
    groups = durable(docs.select("lang", "source").distinct().join(per, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    of_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
    of_lang = of_lang.join(tables.groupBy("lang").agg(F.sum("v").alias("all")), "lang")
    scored = durable(_scored(tables.join(of_lang, "lang"), top), "scored")
    sums = scored.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
gs AS (SELECT g.lang, g.source, coalesce(total, 0)::HUGEINT AS total FROM g LEFT JOIN s USING (lang, source)),
p AS (SELECT gs.lang, gs.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gs.total + 2 * v.v) AS p
      FROM gs JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // ((SELECT sum(total) FROM gs WHERE gs.lang = p.lang) + 2 * (SELECT v FROM v WHERE v.lang = p.lang)) AS q FROM p GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
allp AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT * FROM allp UNION ALL SELECT * FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
