"""The pipeline, stage by stage, on a small table with planted cases."""

import random

import __spark_entry__
import corpus_pipeline
from test_text_operators import WORD, brute_classes, brute_dedup

SYLLABLES = {"aa": ["ka", "ko", "ku", "ra", "li"], "ba": ["ösch", "ent", "ung", "ber", "tz"]}


def prose(lang, rng, n):
    return [("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6)))) for _ in range(n)]


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    shared = prose("aa", rng, 50)
    data = []
    for i in range(80):
        lang = rng.choice(list(SYLLABLES))
        words = prose(lang, rng, rng.randrange(30, 200))
        if i % 10 == 0:
            words[10:10] = shared
        data.append((i, " ".join(words), lang, f"s{i % 4}", 0))
    data += [(100 + i, data[i][1], data[i][2], "s0", 0) for i in range(5)]  # exact copies
    data += [(110 + i, data[i + 11][1] + " ka", data[i + 11][2], "s1", 0) for i in range(5)]  # near copies
    data += [(200, None, "aa", "s0", 0), (201, "", "aa", "s0", 0), (202, "12 34", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    first = sorted(r.doc_id for r in seen["language_id"])
    assert first == sorted(i for i, *_ in data if i < 200)
    texts = [(r.doc_id, r.text) for r in seen["language_id"]]
    stay = sorted(i for i, _, c in brute_classes(texts) if i == c)
    assert sorted(r.doc_id for r in seen["ngram_jaccard_join"]) == stay and not set(stay) & set(range(100, 115))
    want = {i: kept for i, n, gone, kept in brute_dedup([(r.doc_id, r.text) for r in seen["ngram_jaccard_join"]], 35) if gone < n}
    assert {r.doc_id: WORD.findall(r.text) for r in seen["substring_dedup"]} == want
    assert {r.doc_id for r in seen["mixing"]} <= set(want)
    total = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(total(seen["mixing"]) - 1.5 * total(seen["substring_dedup"])) < 0.05 * total(seen["mixing"])
    assert sum(r.n_tokens for r in seen["best_fit_packing"]) == total(seen["mixing"])


def test_join_decides_by_row(spark):
    rng = random.Random(11)
    fresh = lambda: " ".join(prose("aa", rng, 40))
    a, b, c, e, f = (fresh() for _ in range(5))
    lone = [fresh() for _ in range(6)]
    data = [(2, a), (None, a), (6, a + " ka"), (6, lone[0]), (None, lone[1]), (None, lone[2])]  # a null id and half of id 6 go with id 2
    data += [(7, lone[3]), (7, lone[4]), (7, lone[5])]  # one id, unrelated texts
    data += [(8, b), (8, b), (9, c), (9, c + " ra"), (None, e), (None, e), (None, e + " li"), (None, f)]
    data += [(10, None), (10, None), (None, ""), (None, "")]  # without words: no group
    rows = [(i, t, "aa", f"s{k}" if t == b else "s", 0) for k, (i, t) in enumerate(data)]
    rows += [(None, None, "aa", "s", 5), (5, None, "aa", "s", None), rows[11], (12, lone[0] + " x", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(map(tuple, corpus_pipeline.ngram_jaccard_join(spark, df, "").collect()), key=str) for df in (docs, docs.repartition(3))]
    assert runs[0] == runs[1] and set(runs[0]) <= set(rows)
    got = [(i, t) for i, t, *_ in runs[0]]
    assert sorted(i for i, t in got if t == a or t == a + " ka") == [2]
    assert [got.count((i, t)) for i, t in ((6, lone[0]), (None, lone[1]), (None, lone[2]), (7, lone[3]), (7, lone[4]), (7, lone[5]), (8, b), (None, f))] == [1] * 8
    assert sum(i == 9 for i, _ in got) == 1 and sum(bool(t) and t.startswith(e) for _, t in got) == 1 and 12 not in [i for i, _ in got]
    assert sorted((r for r in runs[0] if not r[1]), key=str) == sorted((r for r in rows if not r[1]), key=str)


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def table(spark, folder, n=60, **more):
    rng = random.Random(5)
    data = [(i, " ".join(prose(lang := rng.choice(list(SYLLABLES)), rng, rng.randrange(20, 60))), lang, f"s{i % 3}", 0) for i in range(n)]
    made = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(EXTRA if more.get("extra") else ()):
        made = made.withColumn(name, (made["doc_id"] * 1000 + k).cast("string") if k % 2 else made["doc_id"] * 1000 + k)
    made.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


EXTRA = ["score", "lang_pred", "k1", "k2", "n_words", "n_removed", "size", "copies", "row", "a.b c", "id", "removed_spans", "__d1"]


def test_columns_of_the_input_are_kept(spark, tmp_path):
    docs = table(spark, tmp_path, extra=True)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = docs.collect()
    assert len(got) >= 60
    for r in got:
        assert [r[c] for c in EXTRA] == [str(r.doc_id * 1000 + k) if k % 2 else r.doc_id * 1000 + k for k in range(len(EXTRA))]


def test_two_runs_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table(spark, tmp_path)
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda _: sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())), range(2))
    assert a == b and len(a) > 30 and not corpus_pipeline._held.keys() - {k for k in corpus_pipeline._held if isinstance(k, tuple)}
