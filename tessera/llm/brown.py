"""Language-model scores from Brown classes: exchange clustering and class bigrams.

Tokens are ASCII-lowered words and one end per document.  A text's probability
is the product over its tokens of ``P(class | class before) * P(word | class)``;
the end stands before the first word.

1. A scan turns texts into sequences of slots, a slot being one distinct word of
   a flush (about 6 MB of text).  Exact training counts of all words are summed in
   hash buckets and return to their flush; a word costs one entry per flush.
2. Words met fewer than ``RARE`` times are in classes by the power of two of their
   count; an unknown word is one more word of the rarest of these.  All others are
   clustered: those with at least one in ``SHARE`` of the training tokens (at most
   ``SHARE`` of them, however large the corpus) as in 3 and 4, the rest as in 5.
3. Counts of adjacent pairs (``pairtiles``) are grouped by word, in blocks.
4. The ``CLASSES`` most frequent words begin a class each.  In every round each
   block takes its words out of their class one by one and puts each where the
   likelihood of the class bigrams is greatest, exactly for its own moves, with
   the counts of the round before for those of other blocks.  Moves are applied
   together, or the better half of them if that lowers the likelihood.
5. Each of the rest is placed where the likelihood is greatest, exactly for its own
   neighbours, with the classes of 4 for all others (the rest count as of the power
   of two of their count).  Their neighbours are counted in flushes and merged in
   hash buckets; the classes return to the flushes, and the bigrams of all classes
   are counted again.
6. ``P(class | before) = (n(before, class) + K * P(class)) / (n(before) + K)`` with
   ``K = 5``, and ``P(word | class) = (n(word) + 1) / (N(class) + V(class))``, with one
   more in the rarest class for the unknown word: over all known words, the end and
   one unknown word they sum to 1.

The driver holds the clustered words (``SHARE`` hashes and counts at most, about
8 MB) and a table of classes by classes; nothing else of the corpus.

Defined cases: null text is empty and has only its end; ids may be null, repeated
or of any type; without training rows every word is unknown; repeated rows count
each; an empty table gives an empty result; other columns take no part.  Words are
known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .durable import delete_tables, durable, note_table, noted_tables, text_batches
from .pairtiles import FLUSH_KEYS, bucket_of, count_pairs, n_buckets, run_counts
from .wordbytes import words
from .workers import freeing, freeing_group

CLASSES, ROUNDS, RARE, SHARE = 64, 5, 5, 1 << 19
SMOOTHING = 5.0
_BLOCK_WORDS, _BLOCK_PAIRS = 2048, 1 << 20
_FLUSH_BYTES = 6 << 20


def _narrow(slots: np.ndarray, known: int) -> bytes:
    """Slots as three bytes each, or four where there are more of them."""
    wide = slots.astype("<u4")
    return wide.tobytes() if known > 1 << 24 else np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    if len(blob) == 4 * n:
        return np.frombuffer(blob, "<i4")
    out = np.zeros((n, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(blob, np.uint8).reshape(n, 3)
    return out.reshape(-1).view("<i4")


def _flushes(docs: DataFrame, id_type: T.DataType) -> DataFrame:
    """``(id, train, text)`` as flushes of many rows: slots of the words, the hash of each slot and its training count."""
    schema = T.StructType(
        [T.StructField("flush", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("train", "ptr", "seq", "hashes", "n"))]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []
        size = 0

        def cut() -> pa.RecordBatch:
            hashes, ids, train, lengths = (pa.concat_arrays(x) if i == 1 else np.concatenate(x) for i, x in enumerate(zip(*held)))
            known, seq = np.unique(hashes, return_inverse=True)
            n = np.bincount(seq[np.repeat(train, lengths)], minlength=len(known)).astype(np.int64)
            blobs = (train.astype(np.uint8).tobytes(), np.cumsum(np.concatenate([[0], lengths])).astype(np.int64).tobytes(), _narrow(seq, len(known)), known.tobytes(), n.tobytes())
            rows = pa.LargeListArray.from_arrays(pa.array([0, len(ids)], pa.int64()), ids).cast(pa.list_(ids.type))
            return pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), rows, *(pa.array([b], pa.binary()) for b in blobs)], names=schema.names)

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part in words(batch.column(2)):
                held.append((part.hashes(lower=True), batch.column(0).slice(part.first, part.last - part.first), train[part.first : part.last], np.diff(part.ptr)))
                size += len(part.data) + 64 * (part.last - part.first)
                if size >= _FLUSH_BYTES:
                    yield cut()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield cut()

    return durable(docs.mapInArrow(freeing(task), schema), "flushes")


def _answers(flushes: DataFrame, frequent: int, slots: int) -> DataFrame:
    """Training counts of every slot (``kind`` 0, by flush and bucket), the words met ``frequent`` times (1), and types and tokens by power of two (2)."""
    buckets = n_buckets(slots)
    kinds = "kind int, bucket long, flush long, keys binary, n binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, hashes, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes, n = np.frombuffer(hashes, np.uint64), np.frombuffer(n, np.int64)
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*edges[1:], len(hashes)]
                columns = [pa.array([0] * len(edges), pa.int32()), pa.array(bucket[edges], pa.int64()), pa.array([flush] * len(edges), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary()) for x in (hashes, n))], names=["kind", "bucket", "flush", "keys", "n"])

    def total(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        every = np.concatenate(own)
        keys, count = run_counts(every, np.frombuffer(b"".join(table["n"].to_pylist()), np.int64))
        known = keys[count > 0], count[count > 0]
        many = known[1] >= frequent
        band = np.zeros((2, 64), dtype=np.int64)
        power = np.floor(np.log2(known[1][~many])).astype(np.int64)
        np.add.at(band[0], power, 1)
        np.add.at(band[1], power, known[1][~many])
        found = [count[np.searchsorted(keys, x)].tobytes() for x in own]
        bucket = table["bucket"][0].as_py()
        rows = [(0, bucket, f, b"", n) for f, n in zip(table["flush"].to_pylist(), found)]
        rows += [(1, bucket, None, known[0][many].tobytes(), known[1][many].tobytes()), (2, bucket, None, b"", band.tobytes())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "bucket", "flush", "keys", "n"])

    asked = flushes.select("flush", "hashes", "n").mapInArrow(freeing(ask), kinds)
    return durable(asked.groupBy("bucket").applyInArrow(freeing_group(total), kinds), "answers")


@dataclass
class Vocabulary:
    """Clustered words by frequency, and how the others fall into bands."""

    frequent: int  # occurrences of a clustered word, at least
    hashes: np.ndarray  # ascending
    ids: np.ndarray  # the rank by frequency of each
    count: np.ndarray  # by rank
    bands: np.ndarray  # [types or tokens, band]
    ends: int
    tokens: int
    types: int

    @property
    def end(self) -> int:
        """The unit of the end; those between the words and it are the bands."""
        return len(self.count) + self.bands.shape[1]

    def units(self, hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What each word counts as: its rank, or a number for its band."""
        out = len(self.count) + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)
        many = count >= self.frequent
        out[many] = self.ids[np.searchsorted(self.hashes, hashes[many])]
        return out.astype(np.int32)


def _vocabulary(answers: DataFrame, frequent: int, ends: int) -> Vocabulary:
    got = answers.where("kind = 1").select("keys", "n").toArrow()
    hashes, count = np.frombuffer(b"".join(got["keys"].to_pylist()), np.uint64), np.frombuffer(b"".join(got["n"].to_pylist()), np.int64)
    bands = np.zeros((2, 64), dtype=np.int64)
    parts = answers.where("kind = 2").select("n")
    for i in range(2):  # 128 sums over the buckets, in Spark
        bands[i] = _summed(parts, slice(64 * i, 64 * i + 64))
    order = np.lexsort([hashes, -count])
    hashes, count = hashes[order], count[order]
    by_hash = np.argsort(hashes)
    used = max(1, (frequent - 1).bit_length())
    return Vocabulary(frequent, hashes[by_hash], by_hash.astype(np.int32), count, bands[:, :used], ends, int(count.sum() + bands[1].sum() + ends), len(count) + int(bands[0].sum()) + (ends > 0))


def _summed(blobs: DataFrame, part: slice) -> np.ndarray:
    """Sums of 64-bit blobs (``n``), place by place, within ``part``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = np.frombuffer(blob, np.int64)[part]
                total = own.copy() if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = blobs.select("n").mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum("n")).collect()
    out = np.zeros(part.stop - part.start, dtype=np.int64)
    for at, n in found:
        out[at] = n
    return out


def _coded(flushes: DataFrame, answers: DataFrame, vocabulary) -> DataFrame:
    """Flushes with the training count and the unit of each slot, and the hashes of the slots of the rest."""
    schema = T.StructType([f for f in flushes.schema.fields if f.name not in ("hashes", "n")] + [T.StructField(c, T.BinaryType()) for c in ("count", "unit", "rest")])

    def join(own: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        count = np.frombuffer(b"".join(found["n"].to_pylist()), np.int64)
        hashes = np.frombuffer(own["hashes"][0].as_py(), np.uint64)
        unit = vocabulary.value.units(hashes, count)
        rest = hashes[_is_rest(count, vocabulary.value.frequent)]
        kept = own.drop(["hashes", "n"])
        for name, x in (("count", count), ("unit", unit), ("rest", rest)):
            kept = kept.append_column(name, pa.array([x.tobytes()], pa.binary()))
        return kept

    found = answers.where("kind = 0").select("flush", "bucket", "n")
    return durable(flushes.groupBy("flush").cogroup(found.groupBy("flush")).applyInArrow(join, schema), "coded")


def _is_rest(count: np.ndarray, frequent: int) -> np.ndarray:
    """The words that are clustered, but not among the frequent ones."""
    return (count >= RARE) & (count < frequent)


def _with_ends(values: np.ndarray, ptr: np.ndarray, end: int) -> np.ndarray:
    """The values of all rows, each followed by ``end``."""
    return np.insert(values, ptr[1:], end)


def _trained(end: int):
    """Reads the unit sequences of training rows, ends between them, from coded flushes."""

    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for train, ptr, seq, unit in zip(*(batch.column(i).to_pylist() for i in range(4))):
            train, ptr = np.frombuffer(train, np.uint8).astype(bool), np.frombuffer(ptr, np.int64)
            units = np.frombuffer(unit, np.int32)[_wide(seq, int(ptr[-1]))]
            use = np.repeat(train, np.diff(ptr))
            lengths = np.diff(ptr)[train]
            yield np.concatenate([[end], _with_ends(units[use], np.cumsum(np.concatenate([[0], lengths])), end)]).astype(np.int32)

    return read


def _blocks(pairs: DataFrame, n_words: int) -> DataFrame:
    """Neighbours of the clustered words, after (``side`` 0) and before them, in blocks of words."""
    met = pairs.select(F.sum(F.octet_length("keys")).alias("n")).first()[0] or 0
    blocks = max(-(-n_words // _BLOCK_WORDS), -(-(met // 4) // _BLOCK_PAIRS), 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, n = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                for side, (own, other) in enumerate(((keys >> 32, keys & 0xFFFFFFFF), (keys & 0xFFFFFFFF, keys >> 32))):
                    use = np.flatnonzero(own < n_words)
                    use = use[np.argsort(own[use] % blocks, kind="stable")]
                    block = own[use] % blocks
                    edges = np.flatnonzero(np.diff(block, prepend=-1))
                    spans = list(zip(edges, [*edges[1:], len(use)]))
                    sent = [(own[use[a:b]] << 32 | other[use[a:b]]).tobytes() for a, b in spans]
                    columns = [pa.array(block[edges], pa.int64()), pa.array([side] * len(spans), pa.int32()), pa.array(sent, pa.binary()), pa.array([n[use[a:b]].tobytes() for a, b in spans], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "side", "keys", "n"])

    def gather(table: pa.Table) -> pa.Table:
        out = {"bucket": pa.array([table["bucket"][0].as_py()], pa.int64())}
        for side in (0, 1):
            own = table.filter(pc.equal(table["side"], side))
            keys, n = run_counts(*(np.frombuffer(b"".join(own[c].to_pylist()), np.int64) for c in ("keys", "n")))
            out |= {f"keys{side}": pa.array([keys.tobytes()], pa.binary()), f"n{side}": pa.array([n.tobytes()], pa.binary())}
        return pa.table(out)

    dealt = pairs.select("keys", "n").mapInArrow(freeing(deal), "bucket long, side int, keys binary, n binary")
    return durable(dealt.groupBy("bucket").applyInArrow(freeing_group(gather), "bucket long, keys0 binary, n0 binary, keys1 binary, n1 binary"), "blocks")


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the log-likelihood of the class bigrams that depends on the classes."""
    return float(_h(table).sum() - _h(table.sum(axis=1)).sum() - _h(table.sum(axis=0)).sum())


class Exchange:
    """A table of class bigrams from which words are taken out and put back."""

    def __init__(self, table: np.ndarray, classes: int) -> None:
        self.table, self.classes = table.astype(np.float64), classes
        self.h, self.row, self.col = _h(self.table), self.table.sum(axis=1), self.table.sum(axis=0)

    def add(self, to: int, after: np.ndarray, before: np.ndarray, twice: float, sign: int) -> None:
        """Add (or take) a word's bigrams; ``after`` and ``before`` count it as one of ``to``, where it follows itself ``twice`` times."""
        self.table[to] += sign * after
        self.table[:, to] += sign * before
        self.table[to, to] -= sign * twice
        self.row += sign * before
        self.col += sign * after
        self.row[to] += sign * (after.sum() - twice)
        self.col[to] += sign * (before.sum() - twice)
        self.h[to], self.h[:, to] = _h(self.table[to]), _h(self.table[:, to])

    def gains(self, after: np.ndarray, before: np.ndarray, twice: float) -> np.ndarray:
        """The likelihood gained by putting a word into each class; ``after`` and ``before`` leave out the word itself, which follows itself ``twice`` times."""
        k = self.classes
        some_a, some_b = np.flatnonzero(after), np.flatnonzero(before)
        gain_a = np.zeros((k, len(self.row)))
        gain_b = np.zeros((k, len(self.row)))
        gain_a[:, some_a] = _h(self.table[:k, some_a] + after[some_a]) - self.h[:k, some_a]
        gain_b[:, some_b] = (_h(self.table[some_b, :k] + before[some_b, None]) - self.h[some_b, :k]).T
        own = np.arange(k)
        gain = gain_a.sum(axis=1) + gain_b.sum(axis=1) - gain_a[own, own] - gain_b[own, own]
        gain += _h(self.table[own, own] + after[:k] + before[:k] + twice) - self.h[own, own]
        # Row and column totals change for the class itself and, whichever it is, for the neighbours' classes.
        row, col = self.row + before, self.col + after
        gain -= _h(row[:k] + after.sum() + twice) - _h(row[:k])
        return gain - (_h(col[:k] + before.sum() + twice) - _h(col[:k]))


def _moves(blocks: DataFrame, shared, classes: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that change their class, the class, and what each gains."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in range(batch.num_rows):
                of, table = shared.value
                of, model = of.copy(), Exchange(table, classes)
                sides = [[np.frombuffer(batch.column(i + j)[bucket].as_py(), np.int64) for j in (0, 1)] for i in (0, 2)]
                ids = np.unique(np.concatenate([k >> 32 for k, _ in sides]))
                edges = [np.searchsorted(k >> 32, [ids, ids + 1]) for k, _ in sides]
                moved = []
                for i, word in enumerate(ids.tolist()):
                    context, twice = [], 0.0
                    for (keys, n), (lo, hi) in zip(sides, edges):
                        other, times = keys[lo[i] : hi[i]] & 0xFFFFFFFF, n[lo[i] : hi[i]]
                        mine = other == word
                        twice = float(times[mine].sum())
                        context.append(np.bincount(of[other[~mine]], weights=times[~mine], minlength=width))
                    was, (after, before) = int(of[word]), context
                    own = np.zeros(width)
                    own[was] = twice
                    model.add(was, after + own, before + own, twice, -1)
                    gain = model.gains(after, before, twice)
                    best = int(gain.argmax())
                    if was < classes and gain[best] <= gain[was] + 1e-6:
                        best = was
                    own = np.zeros(width)
                    own[best] = twice
                    model.add(best, after + own, before + own, twice, 1)
                    if best != was:
                        of[word] = best
                        moved.append((word, best, gain[best] - gain[was] if was < classes else math.inf))
                if moved:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*moved), (pa.int64(), pa.int32(), pa.float64()))], names=["word", "to", "gain"])

    got = blocks.select("keys0", "n0", "keys1", "n1").mapInArrow(task, "word long, to int, gain double").toArrow().sort_by("word")
    return tuple(got[c].to_numpy() for c in ("word", "to", "gain"))


def _class_bigrams(pairs: DataFrame, of: np.ndarray, width: int) -> np.ndarray:
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, n = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                cell, sums = run_counts(shared.value[keys >> 32].astype(np.int64) * width + shared.value[keys & 0xFFFFFFFF], n)
                total[cell] += sums
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(width * width, dtype=np.int64)
    for at, n in pairs.select("keys", "n").mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(width, width)


def _sequence_bigrams(coded: DataFrame, of: np.ndarray, end: int, width: int) -> np.ndarray:
    """Bigrams of the classes in the training rows."""
    shared = coded.sparkSession.sparkContext.broadcast(of)
    read = _trained(end)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for units in read(batch):
                classes = shared.value[units].astype(np.int64)
                total += np.bincount(classes[:-1] * width + classes[1:], minlength=width * width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(width * width, dtype=np.int64)
    for at, n in coded.select("train", "ptr", "seq", "unit").mapInArrow(freeing(task), "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(width, width)


def cluster(pairs: DataFrame, vocabulary: Vocabulary, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of every unit, the class bigrams, and the likelihood after each round.

    Classes from ``classes`` on are the bands, the end, and one for words not yet placed, empty in the end.
    """
    n, fixed = len(vocabulary.count), vocabulary.bands.shape[1] + 1
    width = classes + fixed + 1
    of = np.concatenate([np.where(np.arange(n) < classes, np.arange(n), width - 1), classes + np.arange(fixed)]).astype(np.int32)
    blocks = _blocks(pairs, n)
    table = _class_bigrams(pairs, of, width)
    told = []
    for at in range(rounds):
        word, to, gain = _moves(blocks, pairs.sparkSession.sparkContext.broadcast((of, table)), classes, width)
        if not len(word):
            break
        best = likelihood(table)
        order = np.lexsort([word, -gain])
        for take in (1, 2, 4) if at else (1,):
            use = order[: -(-len(order) // take)]
            new = of.copy()
            new[word[use]] = to[use]
            found = _class_bigrams(pairs, new, width)
            if not at or likelihood(found) > best:
                of, table = new, found
                told.append(likelihood(found))
                break
        else:
            break
    return of, table, told


def _neighbours(coded: DataFrame, shared, frequent: int, end: int, width: int, buckets: int) -> DataFrame:
    """The slots of the rest by hash bucket: their hashes, and how often the classes are met after them (codes from 0), before them (from ``width``), and themselves (the last code)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        for batch in batches:
            for flush, train, ptr, seq, count, unit, rest in zip(*(batch.column(i).to_pylist() for i in range(7))):
                hashes = np.frombuffer(rest, np.uint64)
                if not len(hashes):
                    continue
                train, ptr = np.frombuffer(train, np.uint8).astype(bool), np.frombuffer(ptr, np.int64)
                slots = np.flatnonzero(_is_rest(np.frombuffer(count, np.int64), frequent))
                known = len(count) // 8
                place = np.full(known + 1, -1, np.int64)  # the end is one more slot
                place[slots] = np.arange(len(slots))
                classes = of[np.append(np.frombuffer(unit, np.int32), end)].astype(np.int64)
                lengths = np.diff(ptr)
                seq = _wide(seq, int(ptr[-1]))[np.repeat(train, lengths)]
                seq = np.concatenate([[known], _with_ends(seq, np.cumsum(np.concatenate([[0], lengths[train]])), known)])
                a, b = seq[:-1], seq[1:]
                keys = []
                for own, other, base in ((a, b, 0), (b, a, width)):
                    at = np.flatnonzero((place[own] >= 0) & (own != other))
                    keys.append(place[own[at]] * (2 * width + 1) + base + classes[other[at]])
                at = np.flatnonzero((place[a] >= 0) & (a == b))
                keys.append(place[a[at]] * (2 * width + 1) + 2 * width)
                keys, n = run_counts(np.concatenate(keys))
                where = bucket_of(hashes, buckets)
                order = np.argsort(where, kind="stable")
                edges = np.flatnonzero(np.diff(where[order], prepend=-1))
                owner = keys // (2 * width + 1)
                rows = []
                for lo, hi in zip(edges, [*edges[1:], len(order)]):
                    mine = order[lo:hi]  # ascending, as are the owners of the keys
                    first, last = np.searchsorted(owner, mine), np.searchsorted(owner, mine, side="right")
                    size = last - first
                    take = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    own = np.repeat(np.arange(len(mine)), size) * (2 * width + 1) + keys[take] % (2 * width + 1)
                    rows.append((int(where[mine[0]]), flush, hashes[mine].tobytes(), own.astype(np.int64).tobytes(), n[take].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "flush", "hashes", "keys", "n"])

    return coded.select("flush", "train", "ptr", "seq", "count", "unit", "rest").mapInArrow(freeing(task), "bucket long, flush long, hashes binary, keys binary, n binary")


def best_classes(table: np.ndarray, classes: int, band: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The class of the greatest likelihood for each word, the others staying where they are.

    ``after`` and ``before`` count each word's neighbours by class (without itself, which follows itself ``twice`` times), and
    ``table`` holds the word as one of its ``band``.
    """
    k, out = classes, np.empty(len(band), np.int32)
    row, col = table.sum(axis=1)[:k], table.sum(axis=0)[:k]
    own = np.arange(k)
    for i in range(len(band)):
        a, b = np.flatnonzero(after[i]), np.flatnonzero(before[i])
        right, left = table[:k, a].astype(np.float64), table[b, :k].T.astype(np.float64)
        # The word leaves its band: where that is a neighbour's class, the cells hold the word's own bigrams.
        right[:, a == band[i]] -= before[i, :k, None]
        left[:, b == band[i]] -= after[i, :k, None]
        gain = np.zeros(k)
        for cells, at, n in ((right, a, after[i, a]), (left, b, before[i, b])):
            more = _h(cells + n) - _h(cells)
            gain += more.sum(axis=1)
            inner = np.flatnonzero(at < k)
            gain[at[inner]] -= more[at[inner], inner]
        gain += _h(table[own, own] + after[i, :k] + before[i, :k] + twice[i]) - _h(table[own, own])
        gain -= _h(row + after[i].sum() + twice[i]) - _h(row)
        gain -= _h(col + before[i].sum() + twice[i]) - _h(col)
        out[i] = gain.argmax()
    return out


_PLACED = "kind int, flush long, bucket long, unit binary, n binary"


def _placed(asked: DataFrame, shared, classes: int, first_band: int) -> DataFrame:
    """The classes of the rest, by flush and bucket (``kind`` 0), and their types and tokens by class, out of their bands (1)."""

    def place(table: pa.Table) -> pa.Table:
        cells = shared.value[1]
        width = len(cells)
        codes = 2 * width + 1
        own = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        words_, slot = np.unique(np.concatenate(own), return_inverse=True)
        starts = np.cumsum([0, *map(len, own)])
        met = [np.frombuffer(x, np.int64) for x in table["keys"].to_pylist()]
        keys = np.concatenate([slot[at + k // codes] * codes + k % codes for at, k in zip(starts, met)])
        keys, n = run_counts(keys, np.frombuffer(b"".join(table["n"].to_pylist()), np.int64))
        to, moved = np.empty(len(words_), np.int32), np.zeros((2, width), np.int64)
        for lo in range(0, len(words_), 512):
            hi = min(lo + 512, len(words_))
            part = slice(*np.searchsorted(keys, [lo * codes, hi * codes]))
            counts = np.bincount(keys[part] - lo * codes, weights=n[part], minlength=(hi - lo) * codes).reshape(-1, codes)
            after, before, twice = counts[:, :width], counts[:, width:-1], counts[:, -1]
            times = (after.sum(axis=1) + twice).astype(np.int64)  # the end follows the last word
            band = first_band + np.floor(np.log2(np.maximum(times, 1))).astype(np.int64)
            to[lo:hi] = best_classes(cells, classes, band, after, before, twice)
            for at, sign in ((to[lo:hi], 1), (band, -1)):
                np.add.at(moved[0], at, sign)
                np.add.at(moved[1], at, sign * times)
        bucket = table["bucket"][0].as_py()
        rows = [(0, f, bucket, to[slot[a:b]].tobytes(), b"") for f, a, b in zip(table["flush"].to_pylist(), starts, starts[1:])]
        rows.append((1, None, bucket, b"", moved.tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "flush", "bucket", "unit", "n"])

    return durable(asked.groupBy("bucket").applyInArrow(freeing_group(place), _PLACED), "placed")


def _with_rest(coded: DataFrame, placed: DataFrame, buckets: int, frequent: int, end: int) -> DataFrame:
    """``coded`` with the unit of each of the rest behind the end: ``end + 1`` and its class."""

    def join(own: pa.Table, found: pa.Table) -> pa.Table:
        hashes = np.frombuffer(own["rest"][0].as_py(), np.uint64)
        if not len(hashes):
            return own
        to = np.frombuffer(b"".join(found.sort_by("bucket")["unit"].to_pylist()), np.int32)
        unit = np.frombuffer(own["unit"][0].as_py(), np.int32).copy()
        count = np.frombuffer(own["count"][0].as_py(), np.int64)
        mine = np.flatnonzero(_is_rest(count, frequent))
        unit[mine[np.argsort(bucket_of(hashes, buckets), kind="stable")]] = end + 1 + to
        return own.set_column(own.schema.get_field_index("unit"), "unit", pa.array([unit.tobytes()], pa.binary()))

    found = placed.where("kind = 0").select("flush", "bucket", "unit")
    return durable(coded.groupBy("flush").cogroup(found.groupBy("flush")).applyInArrow(join, coded.schema), "classed")


@dataclass
class Model:
    vocabulary: Vocabulary
    classes: np.ndarray  # of every unit
    step: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # tokens and types of every class (and the unknown word)
    likelihoods: list[float]


def _model(vocabulary: Vocabulary, classes: int, of: np.ndarray, table: np.ndarray, moved: np.ndarray, told: list[float]) -> Model:
    """The model of the classes of all units; ``moved``: types and tokens that the rest brings to each class, or takes from a band."""
    table = table[:-1, :-1].astype(np.float64)
    width = len(table)
    tokens, types = np.zeros(width), np.zeros(width)
    np.add.at(tokens, of[: len(vocabulary.count)], vocabulary.count)
    np.add.at(types, of[: len(vocabulary.count)], 1)
    bands = slice(classes, classes + vocabulary.bands.shape[1])
    types[bands], tokens[bands] = vocabulary.bands
    tokens[-1], types[-1] = vocabulary.ends, 1
    types, tokens = types + moved[0, :width], tokens + moved[1, :width]
    share = (tokens + 1) / (tokens.sum() + width)
    step = np.log10((table + SMOOTHING * share) / (table.sum(axis=1, keepdims=True) + SMOOTHING))
    room = tokens + types
    room[classes] += 1  # the unknown word
    return Model(vocabulary, np.append(of, np.arange(classes)).astype(np.int32), step, room, told)


def fit_and_code(docs: DataFrame, train: Column, id_col: str, text_col: str, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A model of the rows where ``train`` holds, and all rows in the units of its vocabulary."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    with noted_tables() as early:
        flushes = _flushes(rows, docs.schema[id_col].dataType)
        slots = flushes.select(F.sum(F.octet_length("hashes"))).first()[0] or 0
        tokens, ends = _training_size(flushes)
        frequent = max(RARE, (tokens + ends) // SHARE + 1)
        answers = _answers(flushes, frequent, slots // 8)
        vocabulary = _vocabulary(answers, frequent, ends)
        shared = spark.sparkContext.broadcast(vocabulary)
    with noted_tables() as own:
        coded = _coded(flushes, answers, shared)
    for path in own:
        note_table(path)
    delete_tables(spark, early)
    with noted_tables() as late:
        pairs = durable(count_pairs(coded.select("train", "ptr", "seq", "unit"), 1, "seq", _trained(vocabulary.end), 2 * FLUSH_KEYS), "pairs")
        of, table, told = cluster(pairs, vocabulary, classes, rounds)
    delete_tables(spark, late)
    moved = np.zeros((2, len(table)), np.int64)
    rest = coded.select(F.sum(F.octet_length("rest"))).first()[0] or 0
    if rest:
        width, buckets = len(table), n_buckets(rest)  # an entry is a slot; its neighbours are a few more numbers
        state = spark.sparkContext.broadcast((of, table))
        with noted_tables() as late:
            placed = _placed(_neighbours(coded, state, frequent, vocabulary.end, width, buckets), state, classes, classes)
            classed = _with_rest(coded, placed, buckets, frequent, vocabulary.end)
            moved = _summed(placed.where("kind = 1").select("n"), slice(0, 2 * width)).reshape(2, width)
        used, path = late[-1], late[:-1]
        delete_tables(spark, path + own)
        note_table(used)
        coded = classed
        table = _sequence_bigrams(coded, np.append(of, np.arange(classes)).astype(np.int32), vocabulary.end, width)
        told.append(likelihood(table))
    return _model(vocabulary, classes, of, table, moved, told), coded


def _training_size(flushes: DataFrame) -> tuple[int, int]:
    """Training words and training rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, rows = 0, 0
            for train, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words_ += int(np.frombuffer(n, np.int64).sum())
                rows += int(np.frombuffer(train, np.uint8).sum())
            yield pa.RecordBatch.from_arrays([pa.array([words_]), pa.array([rows])], names=["words", "rows"])

    got = flushes.select("train", "n").mapInArrow(task, "words long, rows long").agg(F.sum("words"), F.sum("rows")).first()
    return got[0] or 0, got[1] or 0


def scored(coded: DataFrame, model: Model, id_col: str) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` and ``trained`` of every row."""
    id_type = coded.schema["ids"].dataType.elementType
    shared = coded.sparkSession.sparkContext.broadcast((model.classes, model.step, model.room, model.vocabulary.tokens, model.vocabulary.types, model.vocabulary.ends, model.vocabulary.end))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, step, room, tokens, types, ends, end = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).slice(i, 1).flatten()
                kinds = {1: np.uint8, 2: np.int64, 4: np.int64, 5: np.int32}
                train, ptr, count, unit = (np.frombuffer(batch.column(j)[i].as_py(), k) for j, k in kinds.items())
                seq = _with_ends(_wide(batch.column(3)[i].as_py(), int(ptr[-1])), ptr, len(count))
                count, of = np.append(count, ends), np.append(classes[unit], classes[end])
                emit, base = np.log10((count + 1) / room[of]), np.log10((count + 1) / (tokens + types + 1))
                of = of[seq]
                at = ptr[:-1] + np.arange(len(ptr) - 1)
                before = np.concatenate([[classes[end]], of[:-1]])
                sums = [np.add.reduceat(x, at) for x in ((count > 0)[seq].astype(np.int64), base[seq], step[before, of] + emit[seq])]
                n = np.diff(ptr) + 1
                columns = [ids, pa.array(train.astype(bool)), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), tokens)), *map(pa.array, sums[1:]), pa.array(10 ** np.minimum(-sums[2] / n, 300))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kinds = [id_type, T.BooleanType(), *[T.LongType()] * 3, *[T.DoubleType()] * 3]
    out = coded.select("ids", "train", "ptr", "seq", "count", "unit").mapInArrow(task, T.StructType([T.StructField(c, k) for c, k in zip(names, kinds)]))
    return out.withColumnRenamed("id", id_col)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents by a model of those where ``train`` holds."""
    model, coded = fit_and_code(docs, train, id_col, text_col, classes, rounds)
    return scored(coded, model, id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that the production query never learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op13_brown_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ~held_out()).select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
