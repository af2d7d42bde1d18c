"""Versions as deltas: what an edit writes, what reading merges, and what is deleted when nothing names it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import deltas
from tessera.operators.catalog import MAX_VERSIONS, Catalog


def made(spark, n=5000):
    return spark.range(1, n + 1).select(F.col("id").alias("_row_id"), F.concat(F.lit("name "), F.col("id")).alias("s"), (F.col("id") * 0.5).alias("x"))


def edits(spark, rows):
    return spark.createDataFrame(rows, "_row_id long, column string, value string")


def exists(path):
    return os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_an_edit_writes_the_rows_it_changes(spark):
    c = Catalog(spark)
    c.materialize(made(spark), "t")
    got = c.edit("t", edits(spark, [(i, "s", f"new {i}") for i in range(1, 11)]))
    d = c.find("t")
    assert [x.rows for x in d.layers] == [10] and d.row_count == 5000
    assert {r._row_id: r.s for r in got.where("_row_id < 13").collect()} == {i: f"new {i}" if i < 11 else f"name {i}" for i in range(1, 13)}
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_many_edits_equal_a_plain_table(spark, monkeypatch):
    monkeypatch.setattr(deltas, "MOST_LAYERS", 3)
    monkeypatch.setattr("tessera.operators.catalog.MOST_LAYERS", 3)
    rng = random.Random(3)
    c = Catalog(spark)
    c.materialize(made(spark, 60), "t")
    plain = {r._row_id: [r.s, r.x] for r in made(spark, 60).collect()}
    states, layers = [], []
    for _ in range(6):
        what = rng.choice(["edit", "edit", "delete", "append"])
        if what == "edit":
            rows = [(rng.randrange(1, 80), rng.choice("sx"), rng.choice(["", "1.5", "word", "7"])) for _ in range(8)]
            rows = list({(i, k): (i, k, v) for i, k, v in rows}.values())
            c.edit("t", edits(spark, rows))
            for i, k, v in rows:
                if i in plain and not (k == "x" and v == "word"):
                    plain[i] = list(plain[i])
                    plain[i]["sx".index(k)] = None if v == "" else float(v) if k == "x" else v
        elif what == "delete":
            ids = [rng.randrange(1, 80) for _ in range(5)]
            c.delete_rows("t", spark.createDataFrame([(i,) for i in ids], "i long"))
            plain = {i: v for i, v in plain.items() if i not in ids}
        else:
            top = max(plain)
            c.append("t", spark.createDataFrame([("added",)] * 2, "s string"))
            plain |= {top + 1: ["added", None], top + 2: ["added", None]}
        c.record(what)
        states.append(dict(plain))
        layers.append(len(c.find("t").layers))
        assert {r._row_id: [r.s, r.x] for r in c.get("t").collect()} == plain and c.find("t").row_count == len(plain)
    assert max(layers) <= 3 and 0 in layers  # a new base was written meanwhile
    for at in (0, 3, 5):
        c.jump(at)
        assert {r._row_id: [r.s, r.x] for r in c.get("t").collect()} == states[at]


def test_files_go_with_the_last_that_names_them(spark):
    c = Catalog(spark)
    c.materialize(made(spark, 20), "t")
    base = c.find("t").path
    c.edit("t", edits(spark, [(1, "s", "a")]))
    c.record("one")
    layer = c.find("t").layers[0].path
    c.snapshot("kept")
    c.edit("t", edits(spark, [(2, "s", "b")]))
    second = c.find("t").layers[1].path
    assert c.references()[base] == 3 and exists(second)
    c.drop("t")
    assert exists(base) and exists(layer) and not exists(second)  # the version and the snapshot still have the others
    c.restore("kept")
    assert {r._row_id: r.s for r in c.get("t").where("_row_id < 3").collect()} == {1: "a", 2: "name 2"}
    c.drop("t"), c.delete_snapshot("kept")
    assert exists(base) and c.references()[base] == 1
    for i in range(MAX_VERSIONS):
        c.record(str(i))  # pushes the version out
    assert not exists(base) and not exists(layer) and c.references() == {}


def test_a_replaced_dataset_frees_its_files(spark):
    c = Catalog(spark)
    c.materialize(made(spark, 5), "t")
    old = c.find("t").path
    c.materialize(c.get("t").where("_row_id > 2"), "t")
    assert not exists(old) and c.get("t").count() == 3 and len(c.datasets) == 1


def test_names_may_repeat(spark):
    c = Catalog(spark)
    a, b = c.add(made(spark, 2), "t"), c.add(made(spark, 3), "t")
    with pytest.raises(ValueError):
        c.get("t")
    assert (c.get(a.id).count(), c.get(b.id).count()) == (2, 3)
    c.rename(a.id, "first")
    assert c.get("first").count() == 2 and c.get("t").count() == 3


def test_refused_edits_are_listed(spark):
    c = Catalog(spark)
    c.materialize(made(spark, 5), "t")
    batch = edits(spark, [(1, "x", "abc"), (2, "x", "1d"), (3, "x", "2.5"), (9, "s", "no row"), (1, "no column", "v"), (4, "x", "")])
    assert sorted(tuple(r) for r in c.rejected("t", batch).collect()) == [(1, "no column", "v", "no such column"), (1, "x", "abc", "no DOUBLE"), (2, "x", "1d", "no DOUBLE"), (9, "s", "no row", "no such row")]
    with pytest.raises(ValueError):
        c.edit("t", batch, all_or_nothing=True)
    assert {r._row_id: r.x for r in c.edit("t", batch).collect()} == {1: 0.5, 2: 1.0, 3: 2.5, 4: None, 5: 2.5}


def test_layers_survive_a_session(spark, tmp_path):
    c = Catalog(spark)
    c.materialize(made(spark, 5), "t")
    c.edit("t", edits(spark, [(1, "s", "a")]))
    c.delete_rows("t", spark.createDataFrame([(2,)], "i long"))
    c.save(str(tmp_path / "state"))
    again = Catalog.load(spark, str(tmp_path / "state"))
    assert {r._row_id: r.s for r in again.get("t").collect()} == {1: "a", 3: "name 3", 4: "name 4", 5: "name 5"}
