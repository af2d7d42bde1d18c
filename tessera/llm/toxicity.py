"""Toxicity: a linear-chain CRF tags tokens, its marginals score documents.

Tokens are runs of letters, lower-cased.  Labels exist for documents only, so
token labels come from them: a token of a toxic document is toxic if its word or
a leading part of it is met in toxic documents far more than chance allows
(binomial log-likelihood over the training sample) and nearly always there.  How
nearly follows the labels: the most telling word of all is met in documents that
are clean by their label only as often as labels are wrong, and the threshold
falls with its share (``_least_share``).  A two-state linear-chain
CRF over word, prefix and suffix features learns from these sequences;
forward-backward marginals then give each token's probability.  The expected
number of toxic tokens and the largest marginal give a document's score through
a logistic fit on the training documents.

The model learns from a bounded sample of the permitted labelled documents: the
``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean ones with the smallest hash of their
id, one text an id (the shortest where an id is repeated).  Texts above
``LONG_BYTES`` are taken only where there are too few others, and of each kind
none after the first that would bring its bytes above ``MAX_BYTES``.  Every
document is then scored whole.

Defined cases: rows without id have no label and train nothing; null text scores as empty text; a text without letters has no
tokens and scores as clean; null or contradictory labels: null ones are left
out, 1 wins over 0; without a toxic or without a clean example every score is 0;
repeated rows are scored each; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import durable, text_batches
from .wordbytes import SpanHashes, Words, latin_lower, letter_bytes, mix64, windows, words

MAX_TOXIC, MAX_CLEAN, LONG_BYTES, MAX_BYTES = 600, 1600, 16 << 10, 8 << 20
DIMS = 1 << 18
#: Leading bytes of a token that are features, and its last bytes.
PREFIXES, SUFFIX = (4, 5, 6), 3
EPOCHS = 30


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature: score of tag 1 against tag 0
    trans: np.ndarray  # [from, to]
    start: np.ndarray
    doc: np.ndarray  # bias, log1p of the expected count, largest marginal


def _features(part: Words) -> np.ndarray:
    """Hashed features of each token: one row per feature kind."""
    spans = SpanHashes(latin_lower(part.data))
    kinds = [(part.starts, part.ends)]
    kinds += [(part.starts, np.minimum(part.ends, part.starts + k)) for k in PREFIXES]
    kinds += [(np.maximum(part.starts, part.ends - SUFFIX), part.ends)]
    out = np.empty((len(kinds), len(part.starts)), dtype=np.uint64)
    for i, (a, b) in enumerate(kinds):
        out[i] = spans(a, b) ^ np.uint64(0x51ED270B9D0F1 * (i + 1))
    return out


def _index(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(40)).astype(np.int32) & np.int32(DIMS - 1)


def _scan(mats: np.ndarray, block: int = 64) -> np.ndarray:
    """``v[t] = v[t - 1] @ mats[t]`` for all t, each scaled to sum 1, from (1/2, 1/2)."""
    n = len(mats)
    if n <= 2 * block:
        out, v = np.empty((n, 2)), np.array([0.5, 0.5])
        for t in range(n):
            v = v @ mats[t]
            v = out[t] = v / v.sum()
        return out
    rows = -(-n // block)
    if rows * block > n:
        mats = np.concatenate([mats, np.broadcast_to(np.eye(2), (rows * block - n, 2, 2))])
    grid = np.ascontiguousarray(mats.reshape(rows, block, 2, 2).transpose(1, 2, 3, 0))  # step, from, to, row
    whole = grid[0].copy()
    for t in range(1, block):
        m = grid[t]
        whole = np.stack([np.stack([whole[i, 0] * m[0, j] + whole[i, 1] * m[1, j] for j in (0, 1)]) for i in (0, 1)])
        whole /= whole.sum(axis=(0, 1))
    first = np.full((rows, 2), 0.5)
    first[1:] = _scan(np.ascontiguousarray(whole.transpose(2, 0, 1)), block)[:-1]
    v = first.T
    out = np.empty((block, 2, rows))
    for t in range(block):
        m = grid[t]
        v = np.stack([v[0] * m[0, j] + v[1] * m[1, j] for j in (0, 1)])
        v = out[t] = v / v.sum(axis=0)
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def forward_backward(score: np.ndarray, begin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tag 1, and what the pair marginals need, over documents laid end to end.

    ``begin`` marks first tokens: their matrix forgets what stands before, so
    one scan serves all documents exactly.
    """
    n = len(score)
    mats = np.empty((n, 2, 2))
    mats[:] = np.exp(model.trans)
    mats[begin] = np.exp(model.start)[None, None, :]
    mats[:, :, 1] *= np.exp(np.clip(score, -30, 30))[:, None]
    alpha = _scan(mats)
    beta = np.full((n, 2), 0.5)
    if n > 1:
        beta[:-1] = _scan(np.ascontiguousarray(mats[:0:-1].transpose(0, 2, 1)))[::-1]
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), alpha, beta, mats


def _pairs(alpha, beta, mats, begin) -> np.ndarray:
    """Expected number of each transition inside documents."""
    inner = np.flatnonzero(~begin)
    x = alpha[inner - 1][:, :, None] * mats[inner] * beta[inner][:, None, :]
    return (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _token_labels(keys: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents whose word or prefix marks toxic documents."""
    base = toxic.mean()
    out = np.zeros(keys.shape[1], dtype=bool)
    kinds = []
    for kind in range(1 + len(PREFIXES)):
        value, inverse = np.unique(keys[kind], return_inverse=True)
        pair = np.unique(inverse.astype(np.int64) * len(toxic) + doc)
        of, is_toxic = pair // len(toxic), toxic[pair % len(toxic)]
        n = np.bincount(of, minlength=len(value))
        a = np.bincount(of, weights=is_toxic, minlength=len(value))
        share = np.clip(a / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        gain = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
        kinds.append((gain * (share > base), share, inverse))
    best = max(kinds, key=lambda k: k[0].max())
    least = _least_share(float(best[1][best[0].argmax()]), float(base))
    for gain, share, inverse in kinds:
        out |= ((gain > 10) & (share > least))[inverse]
    return out & toxic[doc]


def _least_share(best: float, base: float) -> float:
    """The share of toxic documents that makes a word toxic: 0.97 with clean labels, less as the best word's own share is less, but well above ``base``."""
    return max(0.97 - 2.5 * (1 - best), (1 + base) / 2)


def _first_of_copies(word: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """False for texts that share either of two least hashes of three-word runs with an earlier text: copies would make chance words look telling."""
    out = np.ones(n, dtype=bool)
    for salt in (1, 2):
        least = np.full(n, 2**64 - 1, dtype=np.uint64)
        inner = doc[2:] == doc[:-2]
        run = mix64(windows(mix64(word + np.uint64(salt)), 3))[inner] if len(word) > 2 else np.zeros(0, np.uint64)
        np.minimum.at(least, doc[2:][inner], run)
        seen = least < 2**64 - 1
        first = np.zeros(n, dtype=bool)
        first[np.unique(least, return_index=True)[1]] = True
        out &= first | ~seen
    return out


def train(texts: list[str], toxic: np.ndarray) -> Model | None:
    """The CRF and the document score of labelled texts; None without both kinds."""
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return None
    keys, docs, begins = [], [], []
    for part in words(pa.array(texts, pa.string()), ink_table=letter_bytes()):
        keys.append(_features(part))
        sizes = np.diff(part.ptr)
        docs.append(np.repeat(np.arange(part.first, part.last), sizes))
        begin = np.zeros(len(part.starts), dtype=bool)
        begin[part.ptr[:-1][sizes > 0]] = True
        begins.append(begin)
    key, doc, begin = np.concatenate(keys, axis=1), np.concatenate(docs), np.concatenate(begins)
    if not len(doc):
        return None
    kept = _first_of_copies(key[0], doc, len(toxic))
    if not (toxic & kept).any() or not (~toxic & kept).any():
        return None
    mine = kept[doc]
    key, doc, begin = key[:, mine], doc[mine], begin[mine]
    tag = _token_labels(key, doc, toxic)
    index = _index(key)
    del key, keys
    model = Model(np.zeros(DIMS), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    inner = np.flatnonzero(~begin)
    seen_pairs = np.bincount(2 * tag[inner - 1] + tag[inner], minlength=4).reshape(2, 2)
    seen_start = np.bincount(tag[begin].astype(int), minlength=2)
    seen_x = sum(np.bincount(i, weights=tag, minlength=DIMS) for i in index)
    rate_w, rate_t, rate_s = np.full(DIMS, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    bias = math.log((tag.mean() + 1e-6) / (1 - tag.mean() + 1e-6))
    model.trans[:, 1] = model.start[1] = bias
    for _ in range(EPOCHS):
        p, alpha, beta, mats = forward_backward(model.weights[index].sum(axis=0), begin, model)
        grad = seen_x - sum(np.bincount(i, weights=p, minlength=DIMS) for i in index) - 0.3 * model.weights
        grad_t = seen_pairs - _pairs(alpha, beta, mats, begin)
        grad_s = seen_start - np.array([(1 - p[begin]).sum(), p[begin].sum()])
        for value, g, rate, step in ((model.weights, grad, rate_w, 0.5), (model.trans, grad_t, rate_t, 0.1), (model.start, grad_s, rate_s, 0.1)):
            rate += g * g
            value += step * g / np.sqrt(rate)
    p = forward_backward(model.weights[index].sum(axis=0), begin, model)[0]
    x, toxic = _doc_inputs(p, doc, len(texts))[kept], toxic[kept]
    w = model.doc
    for _ in range(50):  # Newton steps of a ridge logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (q * (1 - q))[:, None]) + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (toxic - q) - 0.1 * w)
        w = w + step * min(1.0, 2.0 / max(np.linalg.norm(step), 1e-12))
    model.doc = w
    return model


def _doc_inputs(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(n), np.log1p(np.bincount(doc, weights=np.where(p >= 0.1, p, 0.0), minlength=n)), most], axis=1)


def _chosen(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple]:
    """``(id, toxic, bytes, hash)`` of the texts to learn from, at most ``MAX_TOXIC + MAX_CLEAN``."""
    known = labels.where(labels[f"`{label_col}`"].isin(0, 1)).groupBy(labels[f"`{id_col}`"].alias("id")).agg(F.max(f"`{label_col}`").alias("toxic"))
    text = docs[f"`{text_col}`"]
    # Texts are looked at once, and what is kept of the labelled ones is stored; others don't reach the grouping.
    sized = docs.where(text.isNotNull()).select(docs[f"`{id_col}`"].alias("id"), F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash")).alias("t"))
    known = durable(sized.join(known, "id").groupBy("id", "toxic").agg(F.min("t").alias("t")).select("id", "toxic", "t.bytes", "t.hash"), "labelled")
    order = (F.col("bytes") > LONG_BYTES), F.xxhash64(F.col("id").cast("string")), F.col("id").cast("string")
    out = []
    for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        total = 0
        for row in known.where(F.col("toxic") == kind).orderBy(*order).limit(most).collect():
            total += row.bytes
            if total > MAX_BYTES and row.bytes < total:  # the first of a kind is taken whatever its length
                break
            out.append(tuple(row))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from the bounded sample; only its texts come to the driver."""
    chosen = _chosen(docs, labels, id_col, text_col, label_col)
    if not chosen:
        return None
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("bytes", T.IntegerType()), T.StructField("hash", T.LongType())])
    some = docs.sparkSession.createDataFrame([(i, int(t), b, h) for i, t, b, h in chosen], kind)
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), text.alias("text"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash"))
    rows = rows.join(F.broadcast(some), ["id", "bytes", "hash"]).groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted((str(r.id), r.text, r.toxic) for r in rows)
    return train([r[1] for r in rows], np.array([r[2] for r in rows], dtype=int))


def tag(docs: DataFrame, model: Model | None, text_col: str = "text", spans: bool = True, least: float = 0.5) -> DataFrame:
    """``docs`` without its text, with ``score``, ``predicted`` and, if asked for, ``spans``.

    ``spans``: array of struct ``first``, ``last`` (byte offsets in UTF-8, the
    last excluded) and ``p``, the tokens whose marginal is at least ``least``.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model and (model.weights.astype(np.float32), model.trans, model.start, model.doc))
    at = docs.columns.index(text_col)
    names = [c for i, c in enumerate(docs.columns) if i != at and c not in ("score", "predicted", "spans")]
    where = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Model(*shared.value)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for part in words(batch.column(at), ink_table=letter_bytes()) if model else ():
                sizes = np.diff(part.ptr)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                begin = np.zeros(len(part.starts), dtype=bool)
                begin[part.ptr[:-1][sizes > 0]] = True
                emit = np.zeros(len(part.starts))
                for index in _index(_features(part)):
                    emit += model.weights[index]
                p = forward_backward(emit, begin, model)[0] if len(emit) else emit
                z = _doc_inputs(p, doc, len(sizes)) @ model.doc
                score[part.first : part.last] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for t in np.flatnonzero(p >= least) if spans else ():
                    base = part.row_at[doc[t]]
                    found[part.first + doc[t]].append({"first": int(part.starts[t] - base), "last": int(part.ends[t] - base), "p": float(p[t])})
            columns = [batch.column(i) for i in where] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{i}" for i in range(len(names))), "score", "predicted", *(["spans"] if spans else [])])

    kinds = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + ["score double", "predicted int"] + ["spans array<struct<first: int, last: int, p: double>>"] * spans)
    return docs.mapInArrow(run, kinds).toDF(*names, "score", "predicted", *(["spans"] if spans else []))


def op4_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs, labels.where(~held_out))
    return tag(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
