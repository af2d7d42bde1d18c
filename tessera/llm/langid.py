"""Language identification in two steps: family, then language.

Texts become frequencies of hashed letter n-grams (two and three bytes of
lower-cased text, everything but letters one blank).  Languages whose mean
profiles are closest form families.  One-versus-one linear support vector
machines (squared hinge) separate the families first, then the languages of the
family chosen; most votes win, ties go to the larger sum of margins.

Learning uses a bounded sample of labelled rows: of the permitted ones the
``PER_LANG`` of each language with the smallest hash of id and text (equal rows
count once), of the ``MAX_LANGS`` languages with the most rows (ties: by name).
Tasks turn the whole texts of the sample into profiles, whatever their length,
and train each pair's machine; the driver sees a mean profile per language and
the weights (32 KB a language and a pair).  A family of many languages takes its
share of rows from each, so no pair learns from more than about
``4 * PER_LANG`` rows.  Every text is then predicted whole; the text alone
decides.

Defined cases: null text, or text without any letter, is ``und`` with score 0;
languages with few texts learn from those; null ids are learned from like
others; with no learnable text everything is ``und``; with one language
everything else is that language with score 1; repeated rows are predicted each;
other columns pass through unless named like a result column.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .durable import durable, text_batches
from .wordbytes import latin_lower, letter_bytes, words
from .workers import freeing

PER_LANG, MAX_LANGS = 400, 200
#: Parts in which the rows of a language are ranked before they are ranked together.
_SALTS = 16
BITS = 13
SLOPE = 2.0


@dataclass
class Model:
    langs: list[str]
    families: list[list[int]]
    pairs: list[tuple[str, int, int]]  # ("family" or "lang", positive, negative)
    weights: np.ndarray  # [pair, feature], the last feature is the bias


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the two- and three-byte n-grams that start at each byte."""
    low = np.where(letter_bytes()[data], latin_lower(data), 32).astype(np.uint32)
    out = []
    for n in (2, 3):
        if len(low) < n:
            continue
        code = np.full(len(low) - n + 1, n, dtype=np.uint32)
        for j in range(n):
            code = (code << np.uint32(8)) | low[j : len(low) - n + 1 + j]
        out.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _profile(text: str) -> np.ndarray:
    """Frequencies of the n-grams of a text, and a one for the bias."""
    out = np.zeros((1 << BITS) + 1, dtype=np.float32)
    for g in _grams(np.frombuffer(text.encode(), dtype=np.uint8)):
        out[:-1] += np.bincount(g, minlength=1 << BITS) * (10.0 / max(len(g), 1))
    out[-1] = 1
    return out


def _packed(profile: np.ndarray) -> bytes:
    """The features of a profile that are not zero, with their values."""
    at = np.flatnonzero(profile)
    return at.astype("<u2").tobytes() + profile[at].astype("<f4").tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    out = np.zeros((len(blobs), (1 << BITS) + 1), dtype=np.float32)
    for row, blob in zip(out, blobs):
        n = len(blob) // 6
        row[np.frombuffer(blob, "<u2", n)] = np.frombuffer(blob, "<f4", n, 2 * n)
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge SVM by accelerated gradient steps in single precision; classes count alike."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    top = np.float32(float((share * np.einsum("ij,ij->i", x, x)).sum()) * 2 + ridge)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(rounds):
        miss = np.maximum(np.float32(0), 1 - y * (x @ v))
        new = v + ((2 * share * miss * y) @ x - np.float32(ridge) * v) / top
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def _families(profiles: np.ndarray) -> list[list[int]]:
    """Average-linkage clusters of language profiles, as many as the square root of the languages."""
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    groups = [[i] for i in range(len(profiles))]
    while len(groups) > max(1, math.ceil(math.sqrt(len(profiles)))):
        a, b = max(itertools.combinations(range(len(groups)), 2), key=lambda p: (near[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] = sorted(groups[a] + groups.pop(b))
    return sorted(groups)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, k, text)``: the labelled rows to learn from, numbered within their language."""
    rows = docs.select(docs[f"`{id_col}`"].cast("string").alias("id"), docs[f"`{text_col}`"].alias("text"), docs[f"`{lang_col}`"].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    null = F.col("id").isNull()
    rows = rows.withColumns({"k1": F.xxhash64("id", null, "text"), "k2": F.xxhash64("text", F.lit("2"), null, "id")}).select("lang", "k1", "k2", "text")
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang")
    order = [F.col("k1"), F.col("k2")]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    keys = rows.select("lang", "k1", "k2").distinct().withColumn("salt", F.pmod("k2", F.lit(_SALTS)))
    few = keys.withColumn("k", rank("lang", "salt")).where(F.col("k") <= PER_LANG)
    some = few.withColumn("k", rank("lang")).where(F.col("k") <= PER_LANG).join(F.broadcast(often), "lang").select("lang", "k", "k1", "k2")
    # At most PER_LANG * MAX_LANGS keys are broadcast; equal rows become one.
    return rows.join(F.broadcast(some), ["lang", "k1", "k2"]).groupBy("lang", "k").agg(F.first("text").alias("text"))


def _pairs(families: list[list[int]]) -> list[tuple[str, int, int]]:
    pairs = [("family", a, b) for a, b in itertools.combinations(range(len(families)), 2)]
    return pairs + [("lang", a, b) for g in families for a, b in itertools.combinations(g, 2)]


def _roles(families: list[list[int]], pairs: list[tuple[str, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each language its pairs: number, side (1 or -1), and how many of its rows take part."""
    family = {i: k for k, g in enumerate(families) for i in g}
    out: dict[int, list[tuple[int, int, int]]] = {i: [] for i in family}
    for at, (kind, a, b) in enumerate(pairs):
        for i in family:
            own = family[i] if kind == "family" else i
            if own in (a, b):
                most = -(-2 * PER_LANG // len(families[own])) if kind == "family" else PER_LANG
                out[i].append((at, 1 if own == a else -1, most))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the bounded sample of ``docs``."""
    text_batches(docs.sparkSession)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [_packed(_profile(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["lang", "k", "profile"])

    def mean(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) + 1)
        for blob in table["profile"].to_pylist():
            total += _unpacked([blob])[0]
        return pa.table({"lang": [table["lang"][0].as_py()], "mean": pa.array([(total[:-1] / table.num_rows).astype("<f4").tobytes()], pa.binary())})

    sample = durable(_sample(docs, id_col, text_col, lang_col).mapInArrow(profile, "lang string, k int, profile binary"), "profiles")
    means = sorted((r.lang, r["mean"]) for r in sample.groupBy("lang").applyInArrow(mean, "lang string, mean binary").collect())
    if not means:
        return None
    names = [lang for lang, _ in means]
    families = _families(np.stack([np.frombuffer(m, "<f4") for _, m in means]))
    pairs = _pairs(families)
    roles = {names[i]: r for i, r in _roles(families, pairs).items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, side, lang, k, blob) for lang, k, blob in zip(*(batch.column(i).to_pylist() for i in range(3))) for at, side, most in roles[lang] if k <= most]
            for at in range(0, len(rows), 1000):
                columns = list(zip(*rows[at : at + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary()))], names=["pair", "side", "lang", "k", "profile"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("k", "ascending")])
        weights = _svm(_unpacked(table["profile"].to_pylist()), table["side"].to_numpy())
        return pa.table({"pair": pa.array([table["pair"][0].as_py()], pa.int32()), "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    dealt = sample.mapInArrow(deal, "pair int, side int, lang string, k int, profile binary")
    got = dict(map(tuple, dealt.groupBy("pair").applyInArrow(learn, "pair int, weights binary").collect())) if pairs else {}
    weights = np.zeros((len(pairs), (1 << BITS) + 1), dtype=np.float32)
    for at, blob in got.items():
        weights[at] = np.frombuffer(blob, "<f4")
    return Model(names, families, pairs, weights)


def _vote(margins: np.ndarray, members: list[int], pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The winner of each row among ``members``, and its least margin (infinite for one member)."""
    votes = {m: np.zeros(len(margins)) for m in members}
    total = {m: np.zeros(len(margins)) for m in members}
    for at, a, b in pairs:
        win = margins[:, at] >= 0
        votes[a] += win
        votes[b] += ~win
        total[a] += margins[:, at]
        total[b] -= margins[:, at]
    rank = np.stack([votes[m] + np.tanh(total[m] / 100) / 4 for m in members], axis=1)
    best = rank.argmax(axis=1)
    least = np.full(len(margins), np.inf)
    for at, a, b in pairs:
        for side, sign in ((a, 1), (b, -1)):
            mine = best == members.index(side)
            least[mine] = np.minimum(least[mine], sign * margins[mine, at])
    return np.array(members)[best], least


def _squash(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(SLOPE * margins, -40, 40)))


def decide(margins: Callable[[list[int], np.ndarray], np.ndarray], n: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language number and score (0 to 1) of ``n`` rows.

    ``margins`` gives those of some pairs (by number) for some rows: those of the
    families for all rows, then those of a family's languages for its rows only.
    """
    of = [(i, a, b) for i, (kind, a, b) in enumerate(model.pairs) if kind == "family"]
    every = np.arange(n)
    local = lambda pairs: [(at, a, b) for at, (_, a, b) in enumerate(pairs)]
    family, least = _vote(margins([i for i, _, _ in of], every), list(range(len(model.families))), local(of))
    lang, score = np.zeros(n, dtype=np.int64), _squash(least)
    for k, members in enumerate(model.families):
        rows = np.flatnonzero(family == k)
        if not len(rows):
            continue
        own = [(i, a, b) for i, (kind, a, b) in enumerate(model.pairs) if kind == "lang" and a in members]
        lang[rows], least = _vote(margins([i for i, _, _ in own], rows), members, local(own))
        score[rows] *= _squash(least)
    return lang, score


def _margins(model: Model, grams: list[np.ndarray], bounds: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[list[int], np.ndarray], np.ndarray]:
    """The margins of pairs for rows whose n-grams lie within ``bounds``; only the bytes of the rows asked for are looked at."""

    def of(pairs: list[int], rows: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(rows), len(pairs)))
        if not pairs:
            return sums
        for own, (lo, hi) in zip(grams, bounds):
            lo, size = lo[rows], (hi - lo)[rows]
            if len(rows) < len(hi):
                ends = np.cumsum(size)
                own = own[np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)]
                lo = ends - size
            for k, pair in enumerate(pairs):
                run = np.concatenate([[0.0], np.cumsum(model.weights[pair][own], dtype=np.float64)])
                sums[:, k] += (run[lo + size] - run[lo]) * 10.0 / np.maximum(size, 1)
        return sums + model.weights[pairs, -1]

    return of


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.families, model.pairs, model.weights))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    where, at = [docs.columns.index(c) for c in names], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Model(*shared.value)
        letters = letter_bytes()
        ascii_letters = letters.copy()
        ascii_letters[128:] = False
        for batch in batches:
            pred, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            for part in words(batch.column(at), ink_table=letters) if model else ():
                n = part.last - part.first
                grams, bounds = _grams(part.data), []
                for own in grams:
                    lo = np.minimum(part.row_at[:-1], len(own))
                    bounds.append((lo, np.clip(part.row_at[1:] - (len(part.data) - len(own)), lo, len(own))))
                lang, how = decide(_margins(model, grams, bounds), n, model)
                plain = np.concatenate([[0], np.cumsum(ascii_letters[part.data])])
                has = plain[part.row_at[1:]] > plain[part.row_at[:-1]]
                for row in np.flatnonzero(~has & (np.diff(part.ptr) > 0)):
                    has[row] = any(c.isalpha() for c in batch.column(at)[part.first + int(row)].as_py())
                rows = np.flatnonzero(has)
                pred[part.first + rows] = np.array(model.langs, dtype=object)[lang[rows]]
                score[part.first + rows] = how[rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in where), pa.array(pred, pa.string()), pa.array(score)], names=[*(f"c{i}" for i in range(len(names))), "lang_pred", "score"])

    kinds = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + ["lang_pred string", "score double"])
    return docs.mapInArrow(freeing(run), kinds).toDF(*names, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """True for the rows that the production queries never learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
