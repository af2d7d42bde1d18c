"""Phrase collocations: which runs of 2 to 5 words belong together.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those at blanks and tabs into words.  Everything is counted per language.

1. Words are counted; those met ``least`` times or more get ids, ranked by
   frequency.  Texts become sequences of ids; a rarer word ends a run, since no
   phrase that is frequent enough has it.
2. Adjacent pairs are counted by direct address (``pairtiles``): dense tiles
   among the most frequent ids, sorted coordinates elsewhere.
3. Pairs met ``least`` times or more are ranked by frequency in turn, and the
   sequences rewritten in their ids.  Two adjacent pair ids are three words, and
   so on up to ``longest`` words: every part of a frequent phrase is frequent.
4. Each phrase carries the counts of its first and last words, so that all cuts
   are scored without another join: ``floor(1000 * a * n / (l * r))`` in
   decimals.  The lowest-scoring cut counts, ties to the shortest first part.
5. A candidate goes if a longer one around it is met as often.  It is enough to
   look one word further: between two phrases met equally often, one inside the
   other, all others are met as often.

A table of ids is broadcast while it has at most ``MAX_LOOKUP`` rows (counted);
beyond that, sequences and table meet in hash buckets and the answers return to
their sequences.  Words are known by 63-bit hashes of language and word.

Defined cases: null text is empty; null language is ``und``, as is that name;
ids and other columns take no part; repeated rows count each; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.taskcontext import TaskContext

from ..operators.rowid import assign_row_id
from .durable import durable, text_batches
from .pairtiles import BLOBS, Gather, bucket_of, count_pairs, merged, n_buckets, pairs_in
from .wordbytes import Words, mix64, words
from .workers import freeing, freeing_group

LEAST, LONGEST, TOP = 100, 5, 2000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Rows of an id table that is broadcast (12 bytes each).
MAX_LOOKUP = 4 << 20
_SEQUENCE = 1 << 16
#: Names of words that a task holds before it sends them.
_NAMES = 1 << 16
_ROWS = "flush long, ids binary, bucket long, langs array<string>, words array<string>"


def _masks() -> tuple[np.ndarray, np.ndarray]:
    stop = np.zeros(256, dtype=bool)
    stop[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    ink = ~stop
    ink[[0x20, 0x09]] = False
    return stop, ink


def _pieces(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Slices of words, and whether a piece ends before each word."""
    stop, ink = _masks()
    for part in words(texts, ink_table=ink):
        ends = np.concatenate([[0], np.cumsum(stop[part.data])])
        fresh = np.zeros(len(part.starts), dtype=bool)
        if len(fresh):
            fresh[0] = True
            fresh[1:] = ends[part.starts[1:]] != ends[part.ends[:-1]]
            inner = part.ptr[:-1]
            fresh[inner[inner < len(fresh)]] = True
        yield part, fresh


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], dtype=np.uint64)


def _word_keys(part: Words, langs: np.ndarray) -> np.ndarray:
    """A positive key of each word with the language of its row."""
    row = np.repeat(langs[part.first : part.last], np.diff(part.ptr))
    return (mix64(part.hashes(lower=True) + row) >> np.uint64(1)).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, Words, np.ndarray, np.ndarray]]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        kinds = list(dict.fromkeys(langs))
        of = dict(zip(kinds, _lang_hashes(kinds)))
        hashes = np.array([of[x] for x in langs], dtype=np.uint64)
        for part, fresh in _pieces(batch.column(1)):
            yield langs, hashes, part, fresh, _word_keys(part, hashes)


def _word_counts(docs: DataFrame, least: int) -> DataFrame:
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = n_buckets(size // 24)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(buckets)
        for *_, keys in _batches(batches):
            yield from gather.add(keys)
        yield from gather.cut()

    return merged(docs.mapInArrow(freeing(task), BLOBS), least, as_rows=True)


def _ranked(counted: DataFrame, name: str) -> DataFrame:
    """``(id int, key, n)``: ids from 0 by frequency."""
    out = assign_row_id(counted, F.desc("n"), F.col("key"), name="__id")
    return durable(out.select((F.col("__id") - 1).cast("int").alias("id"), "key", "n"), name)


def _lookup(table: DataFrame, n: int):
    """A broadcast table of keys (ascending) and ids, of at most ``MAX_LOOKUP`` rows."""
    if n > MAX_LOOKUP:
        raise ValueError("too many rows to broadcast")
    got = table.select("key", "id").toArrow()
    keys, ids = (got[c].to_numpy() for c in ("key", "id"))
    order = np.argsort(keys)
    return table.sparkSession.sparkContext.broadcast((keys[order], ids[order]))


def _find(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The id of each key, -1 for those unknown."""
    have, ids = known
    if not len(have):
        return np.full(len(keys), -1, np.int32)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, ids[at], -1).astype(np.int32)


def _runs(ids: np.ndarray) -> np.ndarray:
    """A sequence without what can't begin or end a pair: ids between two gaps, and all but one of adjacent gaps."""
    known = np.concatenate([[False], ids >= 0, [False]])
    use = known[1:-1] & (known[:-2] | known[2:])
    use |= ~known[1:-1] & np.concatenate([[False], use[:-1]])
    return ids[use]


def _row(flush: int | None, ids: np.ndarray, bucket: int | None = None, langs: list[str] | None = None, texts: list[str] | None = None) -> pa.RecordBatch:
    """A sequence (``flush``), names of words by bucket, or the words of each language in all (``bucket`` -1)."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((flush, ids.tobytes(), bucket, langs, texts), kinds)], names=["flush", "ids", "bucket", "langs", "words"])


class _Names:
    """Language and text of the words that a task meets, sent to buckets by key."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.held: dict[int, tuple[str, str]] = {}

    def add(self, keys: np.ndarray, langs: list[str], texts: list[str]) -> Iterator[pa.RecordBatch]:
        self.held.update(zip(keys.tolist(), zip(langs, texts)))
        if len(self.held) >= _NAMES:
            yield from self.cut()

    def cut(self) -> Iterator[pa.RecordBatch]:
        keys = np.array(list(self.held), dtype=np.int64)
        names = list(self.held.values())
        self.held = {}
        where = bucket_of(keys, self.buckets)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            own = order[lo:hi]
            yield _row(None, keys[own], int(where[own[0]]), [names[i][0] for i in own], [names[i][1].translate(_LOWER) for i in own])


def _named(rows: DataFrame) -> DataFrame:
    """``(key, lang, word)`` of every word, once."""

    def once(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.int64) for k in table["ids"].to_pylist()])
        first = np.unique(keys, return_index=True)[1]
        langs, texts = (pc.list_flatten(table[c]) for c in ("langs", "words"))
        return pa.table({"key": pa.array(keys[first]), "lang": langs.take(pa.array(first)), "word": texts.take(pa.array(first))})

    return rows.where("bucket >= 0").select("bucket", "ids", "langs", "words").groupBy("bucket").applyInArrow(freeing_group(once), "key long, lang string, word string")


def _totals(rows: DataFrame) -> DataFrame:
    """``(lang, n)``: the words of each language in all."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, langs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.frombuffer(blob, np.int64))], names=["lang", "n"])

    return rows.where("bucket = -1").select("ids", "langs").mapInArrow(open_, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _serials() -> Iterator[int]:
    at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    while True:
        yield at
        at += 1


def _key_gaps(keys: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Keys with a gap (-1) before every word that begins a piece."""
    return np.insert(keys, np.flatnonzero(fresh), -1)


def _encoded(docs: DataFrame, known, buckets: int) -> DataFrame:
    """Sequences of word ids; and once per task the names of its words and the words of each language in all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        seen = np.zeros(len(table[0]) + 1, dtype=bool)  # -1 is the last
        total: dict[str, int] = {}
        held: list[np.ndarray] = []
        serial, names = _serials(), _Names(buckets)
        for langs, _, part, fresh, keys in _batches(batches):
            _add_up(total, langs, part)
            ids = _find(keys, table)
            new = np.flatnonzero((ids >= 0) & ~seen[ids])
            new = new[np.unique(ids[new], return_index=True)[1]]
            seen[ids[new]] = True
            yield from names.add(keys[new], *_texts(part, new, langs))
            held.append(_runs(_key_gaps(ids, fresh)))
            if sum(map(len, held)) >= _SEQUENCE:
                yield _row(next(serial), _joined(held))
                held = []
        if held:
            yield _row(next(serial), _joined(held))
        yield from names.cut()
        yield _row(None, np.array(list(total.values()), np.int64), -1, list(total))

    return docs.mapInArrow(freeing(task), _ROWS)


def _add_up(total: dict[str, int], langs: list[str], part: Words) -> None:
    for row, n in enumerate(np.diff(part.ptr).tolist(), part.first):
        total[langs[row]] = total.get(langs[row], 0) + n


def _texts(part: Words, at: np.ndarray, langs: list[str]) -> tuple[list[str], list[str]]:
    """Language and text of some words of a slice."""
    of = np.searchsorted(part.ptr, at, side="right") - 1 + part.first
    return [langs[r] for r in of], [bytes(part.data[part.starts[i] : part.ends[i]]).decode() for i in at]


def _joined(held: list[np.ndarray]) -> np.ndarray:
    gap = np.array([-1], np.int32)
    return np.concatenate([x for part in held for x in (part, gap)]).astype(np.int32)


def _rewritten(sequences: DataFrame, known) -> DataFrame:
    """Sequences in the ids of adjacent pairs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = _runs(_find(_adjacent(np.frombuffer(blob, np.int32)), known.value))
                yield pa.RecordBatch.from_arrays([pa.array([flush], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["flush", "ids"])

    return sequences.select("flush", "ids").mapInArrow(freeing(task), "flush long, ids binary")


def _adjacent(ids: np.ndarray) -> np.ndarray:
    """A key for every two neighbours, -1 where one is a gap."""
    out = np.full(max(len(ids) - 1, 0), -1, np.int64)
    out[np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))] = pairs_in(ids)
    return out


# Beyond MAX_LOOKUP: sequences ask buckets for the ids of their keys.

_ASK = "bucket long, flush long, keys binary, ids binary"


def _bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    return keys % 1_000_003 % buckets


def _asked(sequences: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """``(flush, ids)`` from ``(flush, keys)``, int64 blobs with -1 at gaps, through hash buckets of the id table."""
    buckets = n_buckets(n)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.unique(np.frombuffer(blob, np.int64))
                keys = keys[keys >= 0]
                where = _bucketed(keys, buckets)
                order = np.argsort(where, kind="stable")
                keys, where = keys[order], where[order]
                edges = np.flatnonzero(np.diff(where, prepend=-1))
                sent = [keys[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(keys)])]
                yield pa.RecordBatch.from_arrays([pa.array(where[edges], pa.int64()), pa.array([flush] * len(sent), pa.int64()), pa.array(sent, pa.binary()), pa.nulls(len(sent), pa.binary())], names=["bucket", "flush", "keys", "ids"])

    def answer(asked: pa.Table, have: pa.Table) -> pa.Table:
        keys, ids = (have[c].to_numpy() for c in ("key", "id"))
        order = np.argsort(keys)
        known = (keys[order], ids[order])
        found = [_find(np.frombuffer(k, np.int64), known) for k in asked["keys"].to_pylist()]
        keys = [np.frombuffer(k, np.int64)[f >= 0].tobytes() for k, f in zip(asked["keys"].to_pylist(), found)]
        return pa.table({"bucket": asked["bucket"], "flush": asked["flush"], "keys": pa.array(keys, pa.binary()), "ids": pa.array([f[f >= 0].tobytes() for f in found], pa.binary())})

    def back(own: pa.Table, answers: pa.Table) -> pa.Table:
        keys, ids = np.frombuffer(b"".join(answers["keys"].to_pylist()), np.int64), np.frombuffer(b"".join(answers["ids"].to_pylist()), np.int32)
        order = np.argsort(keys)
        out = [_runs(_find(np.frombuffer(k, np.int64), (keys[order], ids[order]))).tobytes() for k in own["keys"].to_pylist()]
        return pa.table({"flush": own["flush"], "ids": pa.array(out, pa.binary())})

    kept = table.select((F.pmod(F.pmod("key", F.lit(1_000_003)), F.lit(buckets))).alias("bucket"), "key", "id")
    asked = sequences.mapInArrow(freeing(ask), _ASK)
    answers = asked.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(answer, _ASK)
    return sequences.groupBy("flush").cogroup(answers.groupBy("flush")).applyInArrow(back, "flush long, ids binary")


def _keyed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Sequences of word keys; the names of each task's words; and per task the words of each language in all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        serial, names = _serials(), _Names(buckets)
        for langs, _, part, fresh, keys in _batches(batches):
            _add_up(total, langs, part)
            first = np.unique(keys, return_index=True)[1]
            yield from names.add(keys[first], *_texts(part, first, langs))
            yield _row(next(serial), _key_gaps(keys, fresh))
        yield from names.cut()
        yield _row(None, np.array(list(total.values()), np.int64), -1, list(total))

    return docs.mapInArrow(freeing(task), _ROWS)


def _first_level(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences of word ids, ``(id, lang, word, n)`` of every word, and ``(lang, n)`` of every language."""
    n = table.count()
    buckets = n_buckets(8 * n)  # several tasks name each word
    if n <= MAX_LOOKUP:
        out = durable(_encoded(docs, _lookup(table, n), buckets), "encoded")
        sequences = out.where("flush is not null").select("flush", "ids")
    else:
        out = durable(_keyed_texts(docs, buckets), "keyed")
        sequences = durable(_asked(out.where("flush is not null").select("flush", F.col("ids").alias("keys")), table, n), "encoded")
    known = durable(table.join(_named(out), "key").select("id", "lang", "word", "n"), "words")
    return sequences, known, _totals(out)


def _next_level(sequences: DataFrame, table: DataFrame, n: int) -> DataFrame:
    if n <= MAX_LOOKUP:
        return _rewritten(sequences, _lookup(table, n))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_adjacent(np.frombuffer(b, np.int32)).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["flush", "keys"])

    return _asked(sequences.mapInArrow(keyed, "flush long, keys binary"), table, n)


def lowest_cut() -> Column:
    """The lowest score of a phrase's cuts, the words before it, and the counts of its two parts; from ``words, pre, suf, a, n``."""
    whole = "cast({} as decimal(19, 0))"
    score = f"(1000bd * {whole.format('a')} * {whole.format('n')}) div ({whole.format('pre[k - 1]')} * {whole.format('suf[size(words) - k - 1]')})"
    return F.expr(f"array_min(transform(sequence(1, size(words) - 1), k -> struct({score} as score, k, pre[k - 1] as l, suf[size(words) - k - 1] as r)))")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """All candidates: ``lang``, ``words``, ``a``, ``l``, ``r``, ``n``, ``score``, and ``k``, the words before the cut."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit("und")).alias("lang"), docs[f"`{text_col}`"].alias("text"))
    table = _ranked(durable(_word_counts(docs, least), "counts"), "ranks")
    sequences, known, langs = _first_level(docs, table)
    none = F.array().cast("array<bigint>")
    level = known.select("id", "lang", F.array("word").alias("words"), none.alias("pre"), none.alias("suf"), F.col("n").alias("a"))
    levels = []
    for length in range(2, longest + 1):
        pairs = _ranked(durable(count_pairs(sequences.select("ids"), least, as_rows=True), "pairs"), "ranks")
        n = pairs.count()
        left, right = (level.select(*[F.col(c).alias(f"{side}_{c}") for c in level.columns]) for side in "lr")
        ends = pairs.select("id", F.shiftright("key", 32).cast("int").alias("x"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("y"), F.col("n").alias("a"))
        if levels:  # what the level before loses: phrases met as often inside a longer one
            part = ends.select(F.explode(F.array("x", "y")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
            levels[-1] = levels[-1].join(part, "id", "left").where("longer is null or longer < a").drop("longer")
        if not n:
            break
        grown = ends.join(left, ends["x"] == left["l_id"]).join(right, ends["y"] == right["r_id"])
        level = durable(
            grown.select(
                "id", F.col("l_lang").alias("lang"), F.concat("l_words", F.slice("r_words", -1, 1)).alias("words"),
                F.concat("l_pre", F.array("l_a")).alias("pre"), F.concat("r_suf", F.array("r_a")).alias("suf"), "a",
            ),
            "level",
        )
        levels.append(level)
        if length < longest:
            sequences = durable(_next_level(sequences, pairs, n), "sequences")
    if not levels:
        levels = [level.limit(0)]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = out.join(langs, "lang").withColumn("cut", lowest_cut())
    return out.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score", "cut.k")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` candidates by score, count and phrase: ``lang, rank, phrase, a, l, r, n, score``."""
    found = phrases(docs, text_col, lang_col, least, longest).withColumn("phrase", F.concat_ws(" ", "words"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
k AS (SELECT lang, words, unnest(range(1, 6)) AS k FROM w),
i AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM k WHERE len(words) >= k),
f AS (SELECT lang, words[i:i + k - 1] AS g, any_value(k) AS k, count(*) AS f FROM i GROUP BY 1, 2 HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1),
gone AS (SELECT lang, g[1:k - 1] AS g, max(f) AS longer FROM c GROUP BY 1, 2),
gone2 AS (SELECT lang, g[2:k] AS g, max(f) AS longer FROM c GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN gone x USING (lang, g) LEFT JOIN gone2 y USING (lang, g) WHERE greatest(coalesce(x.longer, 0), coalesce(y.longer, 0)) < c.f),
cut AS (SELECT lang, g, k, f, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT c.lang, c.g, c.f AS a, l.f AS l, r.f AS r, t.n, j, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
      FROM cut c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k] JOIN t ON t.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM s),
z AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b WHERE o = 1),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM y WHERE rank <= 2000
"""
