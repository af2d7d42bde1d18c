import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators.catalog import MAX_VERSIONS, Catalog
from tessera.sources import readers, sqlite, writers


def test_csv_keeps_nulls_empty_text_and_quotes(spark, tmp_path, collect):
    df = spark.createDataFrame([(1, None, 1.5), (2, "", None), (3, 'a,"b"', 2.0)], "_row_id long, s string, x double")
    writers.write_csv(df, str(tmp_path / "c"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    assert '2,"",' in text and "1,,1.5" in text and '"a,""b"""' in text
    back = readers.read_csv(spark, str(tmp_path / "c"), schema=df.schema)
    assert collect(back.drop("_row_id")) == collect(df.drop("_row_id"))


def test_csv_rows_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,d\n" + "".join(f"{i},2024-01-0{1 + i % 9}\n" for i in range(500)))
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("_row_id", "bigint"), ("x", "bigint"), ("d", "date")]
    assert all(r._row_id == r.x + 1 for r in df.collect())


def test_ragged_tsv(spark, tmp_path):
    (tmp_path / "b.tsv").write_bytes(b'a\t"q\r\n1\t2\t3\r\nx\ty\tz\tw\r\n')
    df = readers.read_tsv(spark, str(tmp_path / "b.tsv")).orderBy("_row_id")
    assert [tuple(r)[1:] for r in df.collect()] == [("a", '"q', None, None), ("1", "2", "3", None), ("x", "y", "z", "w")]
    named = readers.read_tsv(spark, str(tmp_path / "b.tsv"), header=True)
    assert named.columns == ["_row_id", "a", '"q', "c3", "c4"] and named.count() == 2


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (i INTEGER, b BOOLEAN, n NUMERIC, d DATETIME, x BLOB, p POINT, f REAL)")
        db.executemany("INSERT INTO t VALUES (?,?,?,?,?,?,?)", [(1, 1, 2.5, "2024-01-01", b"z", 3, 0.1), ("word", 0, None, None, None, None, 1e20)])
        db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        db.executemany("INSERT INTO w VALUES (?,?)", [("a", 1), ("b", 2)])
        db.execute("CREATE TABLE empty (a INT)")
    return path


def test_sqlite(spark, database, collect):
    got = sqlite.read_sqlite(spark, database)
    assert set(got) == {"t", "w", "empty"}
    assert collect(got["t"]) == sorted([(1, 1, 1, 2.5, "2024-01-01", None, 3, 0.1), (2, None, 0, None, None, None, None, 1e20)], key=str)
    assert collect(got["w"]) == [(1, "a", 1), (2, "b", 2)] and got["empty"].count() == 0
    assert sqlite.mapped_type("Point") == "BIGINT" and sqlite.mapped_type("double precision") == "DOUBLE" and sqlite.mapped_type(None) == "VARCHAR"


def test_sqlite_in_many_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE r (a INT)")
        db.executemany("INSERT INTO r VALUES (?)", [(i,) for i in range(1000)])
    monkeypatch.setattr(sqlite, "SPLIT_ROWS", 300)
    out = sqlite.read_sqlite(spark, path)["r"].collect()
    assert sorted(r._row_id for r in out) == list(range(1, 1001)) and all(r.a == r._row_id - 1 for r in out)


def test_sqlite_export(spark, tmp_path, collect):
    path = str(tmp_path / "o.db")
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string").repartition(2)
    sqlite.export_sqlite({"one": df, "two": df.where("n = 1")}, path)
    back = sqlite.read_sqlite(spark, path)
    assert collect(back["one"].drop("_row_id")) == collect(df) and back["two"].count() == 1


def test_project_json_and_folder(spark, tmp_path, collect):
    (tmp_path / "p.json").write_text('{"name":"p","version":"1","createdAt":"x","datasets":[{"id":"1","name":"d","sourceType":"csv","columns":[{"name":"a","colType":"INTEGER"},{"name":"b","colType":"BOOLEAN"},{"name":"c","colType":"DOUBLE"}],"rows":[[1,5,true,1e20],[2,null,false,null]]}]}')
    got = readers.read_project(spark, str(tmp_path / "p.json"))["d"]
    assert collect(got) == sorted([(1, 5, True, 1e20), (2, None, False, None)], key=str)
    writers.save_project(spark, "q", {"d": got}, str(tmp_path / "q"))
    assert collect(writers.open_project(spark, str(tmp_path / "q"))["d"]) == collect(got)


@pytest.mark.parametrize("shards", [False, True])
def test_sqlite_export_by_partition(spark, tmp_path, collect, shards):
    path = str(tmp_path / ("folder" if shards else "o.db"))
    df = spark.range(500).select("id", F.concat(F.lit("n"), F.col("id")).alias("s t"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("b")).repartition(5)
    sqlite.export_sqlite({"a/b": df, "none": df.where("false"), "small": df.where("id = 3")}, path, shards=shards)
    back = sqlite.read_sqlite(spark, path)
    assert set(back) == {"a/b", "none", "small"} and back["none"].count() == 0
    assert collect(back["a/b"].drop("_row_id").withColumn("b", F.col("b") == 1)) == collect(df)
    assert sorted(r._row_id for r in back["a/b"].collect()) == list(range(1, 501))
    left = [p.name for p in tmp_path.rglob(".part-*")]
    assert left == [] and (not shards or len(list((tmp_path / "folder").glob("a_b-*.db"))) == 5)
    sqlite.export_sqlite({"small": df.where("id > 490")}, str(tmp_path / "again.db"))
    sqlite.export_sqlite({"small": df.where("id = 7")}, str(tmp_path / "again.db"))
    assert sqlite.read_sqlite(spark, str(tmp_path / "again.db"))["small"].count() == 1


@pytest.mark.parametrize("ids", [[*range(1000), *range(10**15, 10**15 + 1000)], [*range(-50, 700), *[10**9 * i for i in range(1, 300)]], [5], []], ids=["two runs", "a run and a tail", "one", "none"])
def test_sqlite_ranges_have_rows_alike(tmp_path, monkeypatch, ids):
    path = str(tmp_path / "r.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE r (x INT)")
        db.executemany("INSERT INTO r (rowid, x) VALUES (?, 1)", [(i,) for i in ids])
    monkeypatch.setattr(sqlite, "SPLIT_ROWS", 100)
    reader = sqlite._Reader(type("schema", (), {"names": ["__rowid", "x"]}), {"path": path, "dbtable": "r"})
    sizes = [[r[0] for r in reader.read(p)] for p in reader.partitions()]
    assert sorted(i for part in sizes for i in part) == sorted(ids)
    assert max(map(len, sizes)) <= 100 and len(sizes) <= max(1, 4 * len(ids) // 100)


def test_project_files_with_snapshots_and_repeated_names(spark, tmp_path, collect):
    one = lambda key, name, *rows: {"id": key, "name": name, "sourceType": "csv", "columns": [{"name": "a", "colType": "INTEGER"}], "rows": [list(r) for r in rows]}
    file = {"name": "p", "version": "1", "createdAt": "x", "datasets": [one("1", "t", (1, 5)), one("2", "t", (1, 6), (2, 7)), one("3", "empty")], "snapshots": [{"id": "s1", "name": "before", "timestamp": "x", "snapshot": {"datasets": [one("1", "t", (1, 4))]}}]}
    (tmp_path / "p.json").write_text(json.dumps(file))
    got = readers.read_project_file(spark, str(tmp_path / "p.json"))
    assert [(i, n, collect(df)) for i, n, df in got.datasets] == [("1", "t", [(1, 5)]), ("2", "t", [(1, 6), (2, 7)]), ("3", "empty", [])]
    assert [(i, n, collect(df)) for i, n, df in got.snapshots["before"]] == [("1", "t", [(1, 4)])]
    assert {n: df.count() for n, df in readers.read_project(spark, str(tmp_path / "p.json")).items()} == {"t": 1, "t (2)": 2, "empty": 0}


def test_export_all(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "_row_id long, s string")
    assert writers.export_all_csv({"a/b": df, "none": df.select("_row_id")}, str(tmp_path / "x")) == ["a_b"]
    with pytest.raises(ValueError):
        writers.export_all_csv({}, str(tmp_path / "y"))


def test_create_table(spark):
    assert readers.create_table(spark, ["a", "b"], ["INTEGER", "TIMESTAMP"]).dtypes == [("_row_id", "bigint"), ("a", "int"), ("b", "timestamp_ntz")]
    with pytest.raises(ValueError):
        readers.create_table(spark, ["a"], [])


def test_versions_and_snapshots(spark):
    c = Catalog(spark)
    for i in range(3):
        c.materialize(spark.range(i + 1), "n")
        c.record(str(i))
    c.undo(), c.undo()
    assert c.get("n").count() == 1
    c.redo()
    assert c.get("n").count() == 2
    c.materialize(spark.range(9), "n")
    c.record("new")
    assert [label for label, _ in c.log] == ["0", "1", "new"]
    c.snapshot("s"), c.drop("n"), c.restore("s")
    assert c.get("n").count() == 9
    c.rename("n", "m")
    assert [d.name for d in c.list()] == ["m"]
    for i in range(MAX_VERSIONS + 5):
        c.record(str(i))
    assert len(c.log) == MAX_VERSIONS
    with pytest.raises(ValueError):
        c.get("n")


def test_row_ids_of_copies(spark):
    df = readers.numbered(spark.range(3).withColumn("k", F.lit(None).cast("int")), "k")
    assert sorted(r._row_id for r in df.collect()) == [1, 2, 3]


@pytest.mark.parametrize(
    "text, names, rows",
    [
        ("1,a\n2,c\n", ["column0", "column1"], [(1, "a"), (2, "c")]),
        ("a,b\nx,y\n", ["a", "b"], [("x", "y")]),
        ("id,name\n1,x\n", ["id", "name"], [(1, "x")]),
        ("a,1\nb,2\n", ["column0", "column1"], [("a", 1), ("b", 2)]),
        ('id,note,x\n1,"one\nline, ""more""",2.5\n2,,\n', ["id", "note", "x"], [(1, 'one\nline, "more"', 2.5), (2, None, None)]),
    ],
)
def test_csv_header_and_line_breaks(spark, tmp_path, text, names, rows):
    path = tmp_path / "basic.csv"
    path.write_text(text)
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["_row_id", *names] and [tuple(r)[1:] for r in df.orderBy("_row_id").collect()] == rows


def test_far_row_ids_make_few_partitions(tmp_path):
    import sqlite3

    from tessera.sources import sqlite

    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (x INTEGER)")
        db.executemany("INSERT INTO t (rowid, x) VALUES (?, 1)", [(1,), (2**60,)])
    parts = sqlite._Reader(type("schema", (), {"names": ["__rowid", "x"]}), {"path": str(tmp_path / "a.db"), "dbtable": "t"})
    ranges = parts.partitions()
    assert len(ranges) <= sqlite.MOST_SPLITS and sum(len(list(parts.read(r))) for r in ranges) == 2


def test_catalog_outlives_its_session_and_restores_one_table(spark, tmp_path):
    catalog = Catalog(spark)
    for name in ("a", "b"):
        catalog.materialize(spark.range(4).withColumnRenamed("id", "x"), name, "csv")
    catalog.snapshot("s")
    catalog.record("two tables")
    for name in ("a", "b"):
        catalog.materialize(catalog.get(name).where("x > 2"), name)
    catalog.restore("s", only="a")
    catalog.save(str(tmp_path / "state"))
    again = Catalog.load(spark, str(tmp_path / "state"))
    assert {(r.name, r.source_type, r.row_count, r.col_count) for r in again.described().collect()} == {("a", "csv", 4, 1), ("b", "manual", 1, 1)}
    again.jump(0)
    assert again.get("b").count() == 4
    with pytest.raises(ValueError):
        again.restore("s", only="c")
    with pytest.raises(ValueError):
        writers.export_all_csv({"x/y": spark.range(1), "x:y": spark.range(1)}, str(tmp_path / "out"))


def test_project_keeps_snapshots(spark, tmp_path):
    root = str(tmp_path / "p")
    writers.save_project(spark, "p", {"t": spark.range(3)}, root, snapshots={"old": {"t": spark.range(7)}, "none": {}})
    assert writers.open_project(spark, root)["t"].count() == 3
    held = writers.open_snapshots(spark, root)
    assert held["old"]["t"].count() == 7 and held["none"] == {}
