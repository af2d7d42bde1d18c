"""Words that are too rare for the exchange rounds have classes of their own choice, too."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_corpus_statistics import SCHEMA, chains, tokens, trained

from tessera.llm import brown
from tessera.llm.wordbytes import words


def test_best_class_is_that_of_the_greatest_likelihood():
    rng = np.random.default_rng(5)
    n, classes, width = 30, 4, 7
    of = rng.integers(0, width, n)
    of[:12] = rng.integers(classes, width, 12)
    met = rng.integers(0, 3, (n, n)) * rng.integers(0, 5, (n, n))

    def table(of):
        out = np.zeros((width, width))
        np.add.at(out, (of[:, None].repeat(n, 1), of[None, :].repeat(n, 0)), met)
        return out

    rest = [np.arange(n) != w for w in range(12)]
    after = np.array([np.bincount(of[r], met[w, r], width) for w, r in enumerate(rest)])
    before = np.array([np.bincount(of[r], met[r, w], width) for w, r in enumerate(rest)])
    got = brown.best_classes(table(of), classes, of[:12], after, before, met.diagonal()[:12].astype(float))
    for word in range(12):
        every = [brown.likelihood(table(np.where(np.arange(n) == word, c, of))) for c in range(classes)]
        assert every[got[word]] >= max(every) - 1e-6


def test_every_word_met_often_enough_has_a_class(spark, monkeypatch):
    monkeypatch.setattr(brown, "SHARE", 80)
    rows = chains(600)
    rows += [(2000 + i, "en", "a", f"ax{i % 5} odd{i % 7} odd{i % 7} by{i % 3} odd{i % 7}") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model, coded = brown.fit_and_code(docs, trained(), "doc_id", "text", classes=6)
    count = Counter(t for i, _, _, text in rows if i is None or i % 3 for t in tokens(text))
    v = model.vocabulary
    many = {t: n for t, n in count.items() if t and n >= brown.RARE}
    rest = {t for t, n in many.items() if n < v.frequent}
    assert {f"odd{i}" for i in range(7)} <= rest and len(rest) < len(many)

    hashes = {t: next(words(pa.array([t]))).hashes(lower=True)[0] for t in rest}
    found = {}
    for r in coded.select("count", "unit", "rest").collect():
        n, unit = np.frombuffer(r["count"], np.int64), np.frombuffer(r["unit"], np.int32)
        mine = np.frombuffer(r["rest"], np.uint64)
        for h, u in zip(mine.tolist(), unit[(n >= brown.RARE) & (n < v.frequent)].tolist()):
            assert found.setdefault(h, u) == u > v.end  # the same in every flush
    of = {t: int(model.classes[found[int(h)]]) for t, h in hashes.items()}
    assert len(of) == len(rest) == len(found) and max(of.values()) < 6

    def class_of(t):
        if t is None:
            return int(model.classes[v.end])
        return of[t] if t in of else int(model.classes[v.units(next(words(pa.array([t]))).hashes(lower=True), np.array([count[t]]))[0]])

    known = {t: class_of(t) for t in count}
    unmet = class_of("unmet")
    for before in range(len(model.step)):
        total = sum(10 ** model.step[before, c] * (count[t] + 1) / model.room[c] for t, c in known.items()) + 10 ** model.step[before, unmet] / model.room[unmet]
        empty = sum(10 ** model.step[before, c] for c in range(len(model.step)) if c not in known.values() and c != unmet)
        assert abs(total + empty - 1) < 1e-9

    def score(text):
        was, out = class_of(None), 0.0
        for t in tokens(text):
            c = class_of(t)
            out += model.step[was, c] + math.log10((count[t] + 1) / model.room[c])
            was = c
        return round(out, 6)

    got = brown.scored(coded, model, "doc_id").collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), score(text)) for i, _, _, text in rows)
