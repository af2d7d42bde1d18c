"""Classifiers, neighbour search, archives and token counts on small tables."""

import base64
import gzip
import hashlib
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, langid, token_counts, toxicity, warc
from tessera.llm.durable import fresh_path

SYLLABLES = {"aa": ["ka", "ko", "ku", "ra"], "ab": ["ka", "ke", "ki", "ra"], "ba": ["ösch", "ent", "ung", "ber"], "bb": ["ösch", "ant", "ing", "bar"]}


def text(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(0)
    data = [(i, text(lang, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out()))
    assert [[model.langs[i] for i in g] for g in model.families] == [["aa", "ab"], ["ba", "bb"]]
    odd = [(900, None), (901, ""), (902, "123 ... 45"), (903, "日本"), (904, text("ba", rng, 3000)), (905, "١٢")]
    out = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string")), model).collect()}
    held = [r.doc_id for r in docs.where(langid.held_out()).collect()]
    assert np.mean([out[i].lang_pred == data[i][2] for i in held]) > 0.97
    assert [out[i].lang_pred for i in (900, 901, 902, 905)] == ["und"] * 4 and out[903].lang_pred != "und" and out[904].lang_pred == "ba"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_id_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    one = spark.createDataFrame([(1, "abc", "en"), (1, "abc", "en"), (2, "x", None)], "doc_id long, text string, lang string")
    got = langid.identify(one.withColumn("score", F.lit("clash")), langid.fit(one)).collect()
    assert [r.lang_pred for r in got] == ["en"] * 3 and {r.score for r in got} == {1.0}
    assert langid.identify(one, None).first().lang_pred == "und" and langid.identify(none, langid.fit(one)).count() == 0


def test_languages_of_long_texts_and_null_ids_are_learned(spark):
    rng = random.Random(9)
    data = [(None, text("aa", rng), "aa") for _ in range(20)] + [(None, text("ba", rng, 8000), "ba") for _ in range(6)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "ba"]
    new = spark.createDataFrame([(1, text("aa", rng)), (2, text("ba", rng)), (3, text("ba", rng, 9000))], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(new, model).orderBy("doc_id").collect()] == ["aa", "ba", "ba"]


def brute_language(t, model):
    """Votes of single machines on the profile of one text: the family first, then its languages."""
    x = langid._profile(t).astype(float)

    def elect(members, pairs):
        votes, sums = {m: 0 for m in members}, {m: 0.0 for m in members}
        for w, a, b in pairs:
            m = float(x @ w)
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        return max(members, key=lambda m: (votes[m], sums[m], -m))

    of = lambda kind, group: [(w, a, b) for w, (k, a, b) in zip(model.weights, model.pairs) if k == kind and a in group and b in group]
    family = elect(range(len(model.families)), of("family", range(len(model.families))))
    return model.langs[elect(model.families[family], of("lang", model.families[family]))]


def test_votes_match_single_machines(spark):
    rng = random.Random(10)
    model = langid.fit(spark.createDataFrame([(i, text(lang, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 30)], "doc_id long, text string, lang string"))
    mixed = [" ".join(text(rng.choice(list(SYLLABLES)), rng, rng.randrange(1, 6)) for _ in range(3)) for _ in range(60)]
    got = langid.identify(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [brute_language(t, model) for t in mixed]


def brute_marginals(score, model):
    n, total, one = len(score), 0.0, np.zeros(len(score))
    for tags in itertools.product((0, 1), repeat=n):
        e = model.start[tags[0]] + sum(model.trans[a, b] for a, b in zip(tags, tags[1:])) + sum(s for s, t in zip(score, tags) if t)
        total += np.exp(e)
        one += np.exp(e) * np.array(tags)
    return one / total


def test_marginals_are_exact_across_documents():
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    docs = [rng.normal(size=n) * 2 for n in (3, 1, 8, 5)]
    begin = np.concatenate([[True] + [False] * (len(d) - 1) for d in docs])
    got = toxicity.forward_backward(np.concatenate(docs), begin, model)[0]
    assert np.allclose(got, np.concatenate([brute_marginals(d, model) for d in docs]))


def log_partition(score, trans, start):
    n = len(score)
    every = [start[t[0]] + sum(trans[a, b] for a, b in zip(t, t[1:])) + sum(s for s, x in zip(score, t) if x) for t in itertools.product((0, 1), repeat=n)]
    return float(np.logaddexp.reduce(every))


def test_gradient_of_the_field_is_that_of_its_partition_function():
    """Expected transitions, starts and tags are the derivatives of log Z, taken numerically over all tag sequences."""
    rng = np.random.default_rng(8)
    model = toxicity.Model(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    docs = [rng.normal(size=n) for n in (4, 1, 6, 2)]
    begin = np.concatenate([[True] + [False] * (len(d) - 1) for d in docs])
    p, alpha, beta, mats = toxicity.forward_backward(np.concatenate(docs), begin, model)
    whole = lambda trans, start, docs=docs: sum(log_partition(d, trans, start) for d in docs)
    step = 1e-5
    for a, b in itertools.product((0, 1), repeat=2):
        up, down = model.trans.copy(), model.trans.copy()
        up[a, b] += step
        down[a, b] -= step
        assert abs((whole(up, model.start) - whole(down, model.start)) / (2 * step) - toxicity._pairs(alpha, beta, mats, begin)[a, b]) < 1e-6
    one = np.array([0.0, step])
    assert abs((whole(model.trans, model.start + one) - whole(model.trans, model.start - one)) / (2 * step) - p[begin].sum()) < 1e-6
    for i in range(len(docs[2])):
        up, down = docs[2].copy(), docs[2].copy()
        up[i] += step
        down[i] -= step
        slope = (log_partition(up, model.trans, model.start) - log_partition(down, model.trans, model.start)) / (2 * step)
        assert abs(slope - p[5 + i]) < 1e-6


def test_token_labels_match_counting():
    """Tokens of toxic texts are marked by words and prefixes that toxic texts have far beyond chance."""
    rng = random.Random(9)
    plain, bad = ["alpha", "beta", "gamma", "delta", "omega"], ["vilest", "vileness"]
    toxic = np.array([i % 3 == 0 for i in range(60)])
    texts = [" ".join(rng.choices(plain, k=6) + ([rng.choice(bad)] if t else [])) for t in toxic]
    part = next(toxicity.words(pa.array(texts), ink_table=toxicity.letter_bytes()))
    doc = np.repeat(np.arange(60), np.diff(part.ptr))
    got = toxicity._token_labels(toxicity._features(part), doc, toxic)
    tokens = [w for t in texts for w in t.split()]
    assert [bool(x) for x in got] == [bool(toxic[d]) and w in bad for w, d in zip(tokens, doc)]


def test_document_inputs_and_scores():
    rng = np.random.default_rng(2)
    p, doc = rng.random(50), np.sort(rng.integers(0, 8, 50))
    got = toxicity._doc_inputs(p, doc, 9)
    for d in range(9):
        own = p[doc == d]
        assert np.allclose(got[d], [1, np.log1p(own[own >= 0.1].sum()), own.max(initial=0)])
    pool = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, 6)) for _ in range(300)]
    texts = [" ".join([pool[int(x)] for x in rng.integers(0, 300, 8)] + (["vilest"] if i % 4 == 0 else [])) for i in range(120)]
    toxic = np.array([i % 4 == 0 for i in range(120)])
    model = toxicity.train(texts, toxic)
    part = next(toxicity.words(pa.array(texts), ink_table=toxicity.letter_bytes()))
    begin = np.zeros(len(part.starts), dtype=bool)
    begin[part.ptr[:-1]] = True
    emit = sum(model.weights[i] for i in toxicity._index(toxicity._features(part)))
    marginals = toxicity.forward_backward(emit, begin, model)[0]
    z = [1 / (1 + np.exp(-float(toxicity._doc_inputs(marginals[a:b], np.zeros(b - a, int), 1)[0] @ model.doc))) for a, b in zip(part.ptr[:-1], part.ptr[1:])]
    assert [x >= 0.5 for x in z] == toxic.tolist()


def test_block_scan_matches_steps():
    rng = np.random.default_rng(1)
    mats = rng.random((1000, 2, 2)) + 0.01
    assert np.allclose(toxicity._scan(mats, block=8), toxicity._scan(mats, block=1000))


def test_toxicity(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioumnrst") for _ in range(6)) for _ in range(400)]
    data, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(50)]
        if i % 4 == 0:
            words[7] = words[20] = rng.choice(["vilest,", "Vilely", "vileness!"])
        data.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where("doc_id < 300"))
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "12 ..."), (903, "x " * 30000 + "vilely vilely")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.tag(docs.unionAll(odd), model).collect()}
    assert np.mean([out[i].predicted == labels[i][1] for i in range(300, 400)]) > 0.97
    assert [out[i].predicted for i in (900, 901, 902, 903)] == [0, 0, 0, 1]
    span = out[300].spans[0]
    assert data[300][1].encode()[span.first : span.last].lower().startswith(b"vile")


@pytest.fixture
def collected(spark, monkeypatch):
    """The number of rows of every ``collect()`` so far."""
    kind, counts = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: counts.append(len(rows := collect(df))) or rows)
    return counts


def test_samples_are_bounded_in_rows(spark, collected, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(langid, "PER_LANG", 5)
    many = [(1, text("aa", rng), "aa") for _ in range(60)] + [(2, "ösch ent", "ba")] * 60 + [(None, text("ba", rng), "ba") for _ in range(60)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    assert {r.lang: r["count"] for r in langid._sample(docs, "doc_id", "text", "lang").groupBy("lang").count().collect()} == {"aa": 5, "ba": 5}
    collected.clear()
    models = [langid.fit(df) for df in (docs, docs.repartition(3))]
    # A mean per language and the weights of a pair, nothing else, come to the driver.
    assert models[0].langs == ["aa", "ba"] and collected == [2, 1] * 2 and (models[0].weights == models[1].weights).all()
    collected.clear()
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    models = [toxicity.fit(df, labels) for df in (docs, docs.repartition(3))]
    assert collected == [1, 1, 2] * 2 and (models[0].weights == models[1].weights).all()


def noisy_recall(spark, flipped):
    """Recall and false alarms on held-out documents when a share of the training labels is wrong."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioumnrst") for _ in range(6)) for _ in range(600)]
    data, truth, labels = [], [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[7] = words[20] = rng.choice(["vilest,", "Vilely", "vileness!", "brute"])
        data.append((i, " ".join(words)))
        truth.append(toxic)
        labels.append((i, toxic ^ int(rng.random() < flipped)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    out = {r.doc_id: r.predicted for r in toxicity.tag(docs.where("doc_id >= 600"), model).collect()}
    return np.mean([out[i] for i in range(600, 900) if truth[i]]), np.mean([out[i] for i in range(600, 900) if not truth[i]])


@pytest.mark.parametrize("flipped", [0.0, 0.02, 0.05, 0.1])
def test_toxicity_with_wrong_labels(spark, flipped):
    recall, alarms = noisy_recall(spark, flipped)
    assert recall >= 0.97 and alarms <= 0.02


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(12)
    plain = ["".join(rng.choice("aeioumnrst") for _ in range(6)) for _ in range(600)]
    long = lambda *more: " ".join([rng.choice(plain) for _ in range(4000)] + list(more))
    docs = spark.createDataFrame([(i, long("vilest") if i % 2 else long()) for i in range(60)] + [(None, "vilest river")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1)], "doc_id long, toxic int"))
    out = toxicity.tag(docs, model).where("doc_id >= 50").collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    r = toxicity.tag(docs.withColumn("score", F.lit("clash")), None).first()
    assert (r.score, r.predicted, r.spans) == (0.0, 0, [])
    assert toxicity.tag(docs.where("false"), None).count() == 0


def brute_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        s = sorted((-np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v), i) for i, u in rows if i != q and len(u) == len(v))
        out += [(q, n + 1, i) for n, (_, i) in enumerate(s[:k])]
    return sorted(out)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, [1.0, 0.0]), (1001, [0.0, 1.0]), (1002, [1.0, 1.0])]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [None] * 8), (None, v[0].tolist()), (5, v[5].tolist())]
    df = ann.valid_vectors(spark.createDataFrame(rows + odd, "id long, v array<float>"), "id", "v")
    assert df.count() == len(rows) + 1
    got = ann.nearest(ann.build_index(df, 5), df.where("id % 50 = 0"), 5).collect()
    held = [(i, np.array(x, dtype=np.float32).astype(float)) for i, x in rows]
    want = brute_nearest(held, [(i, x) for i, x in held if i % 50 == 0], 5)
    mine = {(r.query_id, r.vec_id) for r in got}
    assert len(mine & {(q, i) for q, _, i in want}) / len(want) >= 0.95
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 150] == [(n + 1, 100 + n) for n in range(5)]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1000] == [1002, 1001]
    assert all(abs(r.score - np.dot(dict(held)[r.query_id], dict(held)[r.vec_id]) / np.linalg.norm(dict(held)[r.query_id]) / np.linalg.norm(dict(held)[r.vec_id])) < 1e-12 for r in got)
    empty = df.where("false")
    assert ann.nearest(ann.build_index(empty, 5), empty, 5).count() == 0


def test_neighbours_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_NODES", 250)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2400, 32))
    df = ann.valid_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v")
    index = ann.build_index(df, 5)
    assert index.count() == 10
    got = {(r.query_id, r.vec_id) for r in ann.nearest(index, df.where("id % 20 = 0"), 5).collect()}
    want = brute_nearest(list(enumerate(v)), [(i, v[i]) for i in range(0, 2400, 20)], 5)
    assert len(got & {(q, i) for q, _, i in want}) / len(want) >= 0.95


def test_parallel_vectors_tie(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=16)
    rows = [(i, (one * (1 + i % 37)).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(100)]
    df = ann.valid_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = ann.nearest(ann.build_index(df, 5), df.where("id in (0, 150, 1000)"), 5).collect()
    near = lambda q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert sorted(near(0)) == [1, 2, 3, 4, 5] and sorted(near(150)) == [0, 1, 2, 3, 4] and len(near(1000)) == 5
    assert all(-1 <= r.score <= 1 for r in got)


def test_shards_grow_with_the_nodes():
    assert [ann.shard_count(n) for n in (0, 1, 4096, 4097)] == [1, 1, 1, 2]
    assert ann.shard_count(10**7) == -(-(10**7) // ann.MOST_NODES) and ann.shard_count(2 * 10**6) == ann.SHARDS


def test_shards_are_bounded_in_bytes(spark, monkeypatch):
    assert ann.shard_count(1000, 1000 * 6 * 1536 * 8) == 1 and ann.shard_count(30_000, 30_000 * 6 * 4096 * 8) == -(-30_000 * 6 * 4096 * 8 // ann.MOST_BYTES)
    monkeypatch.setattr(ann, "MOST_BYTES", 6000)
    rng = np.random.default_rng(3)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 40)))]
    rows = ann.valid_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = ann.build_index(rows, 3).collect()
    assert len(index) >= 3 and max(len(r.vectors) for r in index) < 4 * 6000
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(ann.build_index(rows, 3), rows.where("id < 10"), 3).collect()}
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(10):
        sims = x @ x[q]
        sims[q] = -2
        assert [got[q, r] for r in (1, 2, 3)] == np.argsort(-sims)[:3].tolist()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    blocks = [b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\n" + p for p in (b"", b"a\n\nb\r\n\r\nc", "é".encode() * 9)]
    data = warc.arc_header(version) + b"".join(warc.arc_record(version, f"http://x/{i}", b) for i, b in enumerate(blocks))
    got = list(warc.parse_arc(data))
    assert [b for _, b in got] == blocks and [f["url"] for f, _ in got] == [f"http://x/{i}" for i in range(3)]
    head, _, body = warc.to_warc(*got[2], None).partition(b"\r\n\r\n")
    assert body == blocks[2] and f"Content-Length: {len(body)}".encode() in head and b"WARC-Date: 2024-01-01T00:00:00Z" in head
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_header(version) + b"http://x 1 2\n"))


def test_archives(spark):
    data = [(3, "http://a b", "same"), (1, None, "same"), (2, "u", "same"), (5, "u", None), (4, "u", ""), (6, "u", "é\r\n\r\nWARC/1.0\r\n\r\n" * 50), (7, "u", "x" * 300_000), (7, "u", "x" * 300_000), (None, "u", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.warc_records(pages.withColumn("refers", F.lit(1))), path)
    files = [f"{d}/{n}" for d, _, ns in os.walk(path.removeprefix("file://")) for n in ns if n.endswith(".gz")]
    assert sum(gzip.open(f).read().count(b"WARC-Record-ID") for f in files) == len(data)
    got = sorted(map(tuple, warc.resolved(warc.read_archives(spark, path), "bigint").collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {3: 1, 2: 1, None: 1, 5: 4}
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i in first else "response", first.get(i)) for i, _, h in data]
    assert got == sorted(want, key=str)
    none = fresh_path(spark, "warc")
    warc.write_archives(warc.warc_records(pages.where("false")), none)
    assert warc.resolved(warc.read_archives(spark, none)).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.warc_records(pages, least_bytes=3), path)
    assert {r.page_id: r.record_type for r in warc.resolved(warc.read_archives(spark, path), "bigint").collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def by_page(spark, pages, **options):
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.warc_records(pages, **options), path)
    return path, warc.resolved(warc.read_archives(spark, path), pages.schema["page_id"].dataType.simpleString()).collect()


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_pages_of_one_id_and_url_keep_their_payloads(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST_ROWS", broadcast)
    pages = spark.createDataFrame([("p1", "u", "AAAA"), ("p1", "u", "BB"), ("p3", "u", "BB"), ("x", "v", "AAAA"), (None, "u", "BB")], "page_id string, url string, html string")
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = sorted((tuple(r) for r in by_page(spark, pages)[1]), key=str)
    want = [("p1", 4, sha("AAAA"), "response", None), ("p1", 2, sha("BB"), "response", None), ("p3", 2, sha("BB"), "revisit", "p1"), ("x", 4, sha("AAAA"), "revisit", "p1"), (None, 2, sha("BB"), "revisit", "p1")]
    assert got == sorted(want, key=str)


def test_files_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc.write_archives, "__defaults__", (100_000,))
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 26) * (i % 7) * 6000) for i in range(80)] + [(900, "u", "z" * 50_000_000)], "page_id long, url string, html string").coalesce(1)
    path, got = by_page(spark, pages)
    sizes = [len(gzip.open(f"{d}/{n}").read()) for d, _, ns in os.walk(path.removeprefix("file://")) for n in ns if n.endswith(".gz")]
    assert len(sizes) > 10 and sum(n > 150_000 for n in sizes) == 1
    assert {r.page_id: r.payload_bytes for r in got} == {i: (i % 7) * 6000 for i in range(80)} | {900: 50_000_000}


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_page_ids_may_hold_anything(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST_ROWS", broadcast)
    ids = [" a", "b ", "c", "d\r\ne", "", "é%20", "x: y", None]
    pages = spark.createDataFrame([(i, "u", "same") for i in ids] + [("z", "u", "own")], "page_id string, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in by_page(spark, pages)[1]}
    assert got == {i: (4, "revisit", "") for i in ids if i != ""} | {"": (4, "response", None), "z": (3, "response", None)}


PNG = b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 3


def legacy(version, extra=b""):
    """An archive with an image, a page in Latin-1, a record that is no HTTP response, an url with spaces, and blank lines."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: x\r\n\r\n"
    records = [("http://x/a.png", http + PNG), ("http://x/b c", http + "é".encode("latin-1")), ("dns:x", b"20240101 x. IN A 1.2.3.4\n"), ("http://x/again", http + PNG), ("http://x/none", http)]
    return records, warc.arc_header(version) + b"".join(warc.arc_record(version, u, b) + extra for u, b in records)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", ["plain", "gzip", "members"])
def test_real_archives_are_converted(spark, tmp_path, version, packed):
    records, data = legacy(version, b"\n")
    name = "old.arc" + ("" if packed == "plain" else ".gz")
    cut = data.index(b"http://x/b c")
    (tmp_path / name).write_bytes({"plain": data + b"\n\n", "gzip": gzip.compress(data), "members": gzip.compress(data[:cut]) + gzip.compress(data[cut:])}[packed])
    (tmp_path / "empty.arc").write_bytes(b"")
    got = sorted(warc.read_arc(spark, f"file://{tmp_path}").collect(), key=lambda r: r.place)
    assert [(r.url, bytes(r.block)) for r in got] == records and {r.version for r in got} == {version}
    path = fresh_path(spark, "warc")
    warc.convert_archives(spark, f"file://{tmp_path}", path, file_bytes=1)
    back = {r.target_uri: r for r in warc.read_archives(spark, path).collect()}
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    whole = {u: warc._payload(b) for u, b in records}
    assert {u: r.stored_digest for u, r in back.items()} == {u: sha(b) for u, b in whole.items()}
    assert {u: r.record_type for u, r in back.items()} == {"http://x/a.png": "response", "http://x/b c": "response", "dns:x": "resource", "http://x/again": "revisit", "http://x/none": "response"}
    assert back["http://x/again"].refers_to_id == back["http://x/a.png"].record_id and len({r.record_id for r in back.values()}) == 5
    assert {u: (r.payload_bytes, r.payload_digest) for u, r in back.items() if r.record_type != "revisit"} == {u: (len(b), sha(b)) for u, b in whole.items() if u != "http://x/again"}


def test_damaged_archives(tmp_path):
    _, data = legacy(1)
    assert [len(b) for _, b in warc.parse_arc(data[:-20])][:4] == [len(b) for _, b in warc.parse_arc(data)][:4]
    assert list(warc.parse_arc(warc.arc_header(2))) == []
    with pytest.raises(ValueError):
        list(warc.parse_arc(data + b"http://x/ 0.0.0.0 20240101000000 text/html many\n"))


def brute_allocate(token_ends, section_ends):
    out, a = [], 0
    for b in token_ends:
        held, s = [], 0
        for e in section_ends:
            held.append(max(0, min(b, e) - max(a, s)))
            s = e
        out.append(held.index(max(held)))
        a = b
    return out


def test_allocation():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randrange(1, 60)
        cut = lambda: np.array([*sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(8)))), n])
        tokens, sections = cut(), cut()
        assert token_counts.allocate(tokens, sections).tolist() == brute_allocate(tokens.tolist(), sections.tolist())


def test_token_counts(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    back = {v: k for k, v in ranks.items()}
    data = [(1, None), (2, ""), (3, "one line"), (4, "a\n\n\nb  \n  c\né日本\n"), (5, "<|endoftext|> x"), (5, "<|endoftext|> x"), (6, "long line \n" * 9000)]
    out = token_counts.line_token_counts(spark.createDataFrame(data, "doc_id long, text string")).collect()
    for i, t in dict(data).items():
        rows = sorted((r for r in out if r.doc_id == i), key=lambda r: r.section or 0)
        if t is None:
            assert [(r.section, r.n_tokens) for r in rows] == [(None, 0)]
            continue
        tokens = enc.encode_ordinary(t)
        ends = np.cumsum([len(back[k]) for k in tokens]).tolist()
        lines = t.splitlines(keepends=True) or [""]
        bounds = np.cumsum([len(x.encode()) for x in lines]).tolist()
        times = 2 if i == 5 else 1
        if len(lines) < 99:
            where = brute_allocate(ends, bounds)
            assert [r.n_tokens for r in rows] == [where.count(k) for k in range(len(lines)) for _ in range(times)]
            assert [t[r.section_start : r.section_end] for r in rows] == [x for x in lines for _ in range(times)]
        assert sum(r.n_tokens for r in rows) == times * len(tokens)


def test_long_runs_of_blanks(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split, whole, _ = token_counts._encoding(open(token_counts.VOCABULARY, "rb").read())
    rng = random.Random(13)
    for blank in (" ", "\n", "\t \n", "\u3000 ", "\x85\xa0"):
        run = "".join(rng.choice(blank) for _ in range(5000))
        for t in (run, "ab" + run, run + "ab", "ab 1" + run + "!?" + run + " c" + run, "é" + run + "\x1f" + run):
            assert token_counts.encode(t, split, whole) == enc.encode_ordinary(t)
    million = 2_000_000
    texts = [" " * million, "\n" * million, "a" * million, "x" + " " * million + "y", "x" + "\r\n" * million + "y"]
    out = token_counts.line_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("n_tokens").alias("n")).orderBy("doc_id").collect()
    assert [r.lines for r in out] == [1, million, 1, 1, million + 1]
    assert out[0].n == len(whole.encode_ordinary(texts[0])) and out[2].n == len(enc.encode_ordinary(texts[2])) and out[3].n == 1 + len(whole.encode_ordinary(" " * (million - 1))) + len(enc.encode_ordinary(" y"))


def test_every_line_of_a_long_text(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(14)
    t = "".join("".join(rng.choice("ab é.\u3000") for _ in range(rng.randrange(9))) + "\n" * rng.randrange(1, 4) for _ in range(900))
    lengths = [len(enc.decode_single_token_bytes(k)) for k in enc.encode_ordinary(t)]
    lines = t.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    where = brute_allocate(np.cumsum(lengths).tolist(), np.cumsum([len(x.encode()) for x in lines]).tolist())
    out = token_counts.line_token_counts(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("section").collect()
    assert [r.n_tokens for r in out] == [where.count(k) for k in range(len(lines))]
    with pytest.raises(ValueError):
        token_counts.line_token_counts(spark.createDataFrame([(1, t)], "n_tokens long, text string"), "n_tokens")


def test_field_token_counts(spark):
    df = spark.createDataFrame([(1, "title", None, "body text")], "id long, a string, b string, c string")
    out = token_counts.field_token_counts(df, ["a", "b", "c"], "id").orderBy("section").collect()
    assert [r.field for r in out] == ["a", "b", "c"] and out[1].n_tokens == 0 and sum(r.n_tokens for r in out) > 2
    assert token_counts.line_token_counts(df.where("false"), "id", "a").count() == 0
