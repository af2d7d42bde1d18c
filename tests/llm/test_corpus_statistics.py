"""Collocations, source divergence and Brown scores against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import brown, collocations, divergence
from tessera.llm.pairtiles import pair_keys, run_counts, tile_counts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(seed, n=60, vocabulary=12):
    """Texts over few words, some with marks between, capitals, nulls, blanks and repeated rows."""
    rng = random.Random(seed)
    names = [f"w{i}" if i % 3 else f"Éw{i}A" for i in range(vocabulary)]
    out = []
    for i in range(n):
        ws = [names[min(int(rng.expovariate(0.4)), vocabulary - 1)] for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\r\n"]) for w in ws)
        out.append((i, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", None, "c"]), text.upper() if i % 7 == 0 else text))
    return out + [out[3], (None, "en", "a", None), (900, "fr", "b", ""), (901, None, None, " \t\n"), (902, "xx", "q", "...")]


SCHEMA = "doc_id long, lang string, source string, text string"


# Pairs and tiles.


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=60))
def test_few_pairs_are_counted(pairs):
    keys = pair_keys(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))
    got = dict(zip(*(x.tolist() for x in tile_counts(keys))))
    assert got == Counter(keys.tolist())


def test_dense_and_sparse_tiles_agree_with_a_plain_count():
    rng = np.random.default_rng(1)
    a, b = (np.minimum(rng.zipf(1.3, 200_000) - 1, 1 << 20) for _ in range(2))
    keys = pair_keys(a, b)
    got = run_counts(*tile_counts(keys))
    want = np.unique(keys, return_counts=True)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


# Collocations.


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, lang, _, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and c >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [None, 0])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, most):
    """``most`` 0: id tables are never broadcast."""
    if most is not None:
        monkeypatch.setattr(collocations, "MAX_LOOKUP", most)
    rows = texts(seed)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=4, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 4, 25)


def test_collocations_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).collect() == []
    few = spark.createDataFrame([(1, "en", "a", "one two"), (2, None, None, None)], SCHEMA)
    assert collocations.collocations(few, least=3).collect() == []
    long = spark.createDataFrame([(1, "en", "x", "ab cd " * 50_000)], SCHEMA).withColumn("n", F.lit(5)).withColumn("score", F.lit("x"))
    got = {r.phrase: (r.a, r.n) for r in collocations.collocations(long).collect()}
    # Every shorter run but one begins one place later at most, so each length is met once less.
    assert got["ab cd ab cd ab"] == (49_998, 100_000) and got["cd ab cd ab cd"] == (49_998, 100_000)


def test_scores_beyond_64_bits_are_exact(spark):
    rng = random.Random(3)
    rows = [([f"{i}", "b", "c"], [rng.randrange(1, 10**13), rng.randrange(1, 10**12)], [rng.randrange(1, 10**13), rng.randrange(1, 10**12)], rng.randrange(10**9, 10**10), rng.randrange(10**13, 10**14)) for i in range(50)]
    got = spark.createDataFrame(rows, "words array<string>, pre array<long>, suf array<long>, a long, n long").select("*", collocations.lowest_cut().alias("cut")).collect()
    for r in got:
        want = min((1000 * r.a * r.n // (r.pre[k - 1] * r.suf[2 - k]), k) for k in (1, 2))
        assert (r.cut.score, r.cut.k) == want


# Source divergence.


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(of[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and of[s][t] > q[t])[:top]
            out += [(lang, s, part, x.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, x) in enumerate(found, 1)]
    return sorted(out)


def awkward_terms(seed):
    rng = random.Random(seed)
    pool = ["a", "Bb", "ccccccc", "dddddddd", "eeeeeeeee", "f" * 16, "g" * 17, "h" * 40, "h" * 39 + "i", "é" * 4, "é" * 8 + "x", "漢字" * 9, "Z" * 3000]
    return [(i, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), " ".join(rng.choice(pool) + rng.choice(["", "1", "-"]) for _ in range(rng.randrange(30)))) for i in range(40)]


@pytest.mark.parametrize("rows", [texts(1), texts(5, 40), awkward_terms(1)], ids=["words", "more", "lengths"])
def test_divergence_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(divergence, "BUCKET_ENTRIES", 64)
    monkeypatch.setattr(divergence, "_CELLS", 16)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("value", F.lit(1)), least=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 3, 4)


def test_divergence_of_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    few = [(1, "en", "a", "x y"), (2, "en", None, None), (2, "en", "b", "x"), (3, None, "z", "")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(few, SCHEMA)).collect())) == brute_divergence(few, 10, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).filter(lambda b: 0 not in b), max_size=30))
def test_packed_terms_sort_as_bytes(terms):
    for width in (8, 16, 64):
        own = [t for t in terms if len(t) <= width]
        data = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum([len(t) for t in own], dtype=np.int64)
        starts = ends - np.array([len(t) for t in own], dtype=np.int64)
        order = divergence.term_order(divergence.packed(data, starts, ends, width), np.arange(len(own)))
        assert [own[i] for i in order] == sorted(own)


@given(st.integers(1, 10**15), st.integers(0, 10**15))
def test_shares_are_exact(a, more):
    got = divergence.share(np.array([a]), np.array([a + more]))
    assert got.tolist() == [1 + 10**9 * a // (a + more)]


# Brown scores.


def chains(n=400, seed=2):
    """Texts of two made-up languages whose words alternate between two kinds; a bigram of classes tells more than single words."""
    rng = random.Random(seed)
    kinds = {k: [f"{k}{i}" for i in range(15)] for k in ("ax", "by", "cz", "dw")}
    out = []
    for i in range(n):
        first, second = rng.choice([("ax", "by"), ("cz", "dw")])
        out.append((i, "en", "a", " ".join(rng.choice(kinds[first if j % 2 else second]) for j in range(rng.randrange(4, 30)))))
    return out + [(1000, "en", "a", "never met words ax1"), (1001, None, None, None), (None, "en", "a", "ax1 by2"), (5, "en", "a", out[5][3])]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def trained():
    return F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(chains(), SCHEMA).repartition(3).withColumn("score", F.lit("mine"))
    model, coded = brown.fit_and_code(docs, trained(), "doc_id", "text", classes=6)
    return model, brown.scored(coded, model, "doc_id").collect()


def test_base_scores_equal_brute_force(fitted):
    _, got = fitted
    rows = chains()
    count = Counter(t for i, _, _, text in rows if i is None or i % 3 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    base = lambda text: sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(text))
    want = sorted((str(i), len(tokens(text)), sum(count[t] > 0 for t in tokens(text)), n, round(base(text), 6)) for i, _, _, text in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert {str(r.doc_id) for r in got if not r.trained} == {str(i) for i, *_ in rows if i is not None and i % 3 == 0}


def test_scores_follow_the_model(fitted):
    """Every score from the model's own tables, word by word."""
    from tessera.llm.wordbytes import words
    import pyarrow as pa

    model, got = fitted
    rows = chains()
    count = Counter(t for i, _, _, text in rows if i is None or i % 3 for t in tokens(text))
    v = model.vocabulary

    def of(word):
        if word is None:
            return int(model.classes[v.end])
        h = next(words(pa.array([word]))).hashes(lower=True)
        return int(model.classes[v.units(h, np.array([count[word]]))[0]])

    known = {t: of(t) for t in count}
    for before in range(len(model.step)):
        total = sum(10 ** model.step[before, c] * (count[t] + 1) / model.room[c] for t, c in known.items()) + 10 ** model.step[before, of("unmet")] / model.room[of("unmet")]
        # A class without words keeps its smoothed share to itself.
        empty = sum(10 ** model.step[before, c] for c in range(len(model.step)) if c not in known.values() and c != of("unmet"))
        assert abs(total + empty - 1) < 1e-9

    def score(text):
        was, out = of(None), 0.0
        for t in tokens(text):
            c = of(t)
            out += model.step[was, c] + math.log10((count[t] + 1) / model.room[c])
            was = c
        return round(out, 6)

    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), score(text)) for i, _, _, text in rows)


def test_classes_tell_more_than_words(fitted):
    model, got = fitted
    assert model.likelihoods == sorted(model.likelihoods)
    held = [r for r in got if not r.trained and r.n_known == r.n_tokens]
    assert len(held) > 50 and sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(4)
    n, classes, width = 30, 4, 7
    of = rng.integers(0, width, n)
    met = rng.integers(0, 3, (n, n)) * rng.integers(0, 5, (n, n))

    def table(of):
        out = np.zeros((width, width))
        np.add.at(out, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), met)
        return out

    model = brown.Exchange(table(of), classes)
    for word in range(n):
        twice = float(met[word, word])
        rest = np.arange(n) != word
        after, before = np.bincount(of[rest], met[word, rest], width), np.bincount(of[rest], met[rest, word], width)
        own = lambda c: np.eye(width)[c] * twice  # noqa: B023, E731
        model.add(of[word], after + own(of[word]), before + own(of[word]), twice, -1)
        gain = model.gains(after, before, twice)
        every = [brown.likelihood(table(np.where(np.arange(n) == word, c, of))) for c in range(classes)]
        assert np.allclose(gain - gain[0], np.array(every) - every[0], atol=1e-6)
        of[word] = int(gain.argmax())
        model.add(of[word], after + own(of[word]), before + own(of[word]), twice, 1)
        assert np.allclose(model.table, table(of)) and np.allclose(model.row, model.table.sum(axis=1)) and np.allclose(model.col, model.table.sum(axis=0))


def test_brown_scores_of_odd_tables(spark):
    none = brown.score(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert none.collect() == [] and none.columns[:2] == ["doc_id", "trained"]
    untrained = brown.score(spark.createDataFrame([(1, "en", "a", "x y"), (2, None, None, None)], SCHEMA), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in untrained) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in untrained)
    names = brown.score(spark.createDataFrame([("é", "x " * 30_000), (None, "")], "name string, body string"), F.lit(True), "name", "body").collect()
    assert {r.name: r.n_tokens for r in names} == {"é": 30_001, None: 1}
