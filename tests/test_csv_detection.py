"""CSV dialects and kinds against DuckDB's own detection."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.textkinds import as_kind, kind_of, kinds_met
from tessera.sources import dialect, readers

FILES = {
    "semicolon": "a;b\n1;2\n3;4\n",
    "tab": "a\tb\n1\tx y\n2\tz\n",
    "pipe": "a|b\n1|x\n2|y\n",
    "decimal commas": "a;b\n1,5;2\n3,4;4\n",
    "times": "at,n\n10:00:00,1\n11:30,2\n",
    "day first": "d,x\n31/12/2024,1\n01/02/2024,2\n",
    "day or month first": "d,x\n01/02/2024,1\n03/04/2024,2\n",
    "month first": "d,x\n12/31/2024,1\n01/02/2024,2\n",
    "dots": "d,x\n31.12.2024,1\n1.2.2024,2\n",
    "slashes": "d,x\n2024/1/5,1\n2024/11/15,2\n",
    "short years": "d,x\n24-1-5,1\n24-12-31,2\n",
    "padded": "a,b\n 5,1\n 6,2\n",
    "repeated names": "a,a,A\n1,2,3\n",
    "words": "a,b\ntrue,yes\nFALSE,No\nt,f\n",
    "missing": "a,b\n1,x\n,y\n3,\n",
    "decimals": "a,b\n1e5,1.\n2.5,.5\n-3,-0.25\n",
    "moments": "a,b\n2024-01-01 10:00:00,2024-01-01T10:00:00\n2024-01-02 11:30:00.5,2024-03-01T23:59:59\n",
    "moments day first": "a,b\n31/12/2024 10:11:12,1\n01/01/2025 00:00:00,2\n",
    "half days": "a,b\n12/31/2024 10:11:12 PM,1\n01/01/2025 12:00:00 AM,2\n",
    "single quotes": "'a','b'\n'x,y','z'\n'p,q','r'\n",
    "quoted delimiters": '"a;b";c\n"1;2";3\n"4;5";6\n',
    "breaks": 'a,b\n"x\ny, ""z""",2\nplain,3\n"""q""\n\nr",4\n',
    "no names": "1,2\n3,4\n",
    "one column": "x\n1\n2\n",
    "leading zeros": "a,b\n007,1\n008,2\n",
    "quoted numbers": 'a,b\n"1","2"\n"3","4"\n',
    "hexadecimal": "a,b\n0x10,1\n0xff,2\n",
    "windows": "a,b\r\n1,x\r\n2,y\r\n",
    "names only": "a,b\n",
    "all text": "name,city\nann,rome\nbob,oslo\n",
}
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def plain(value):
    return str(value) if isinstance(value, datetime.time) else value


@pytest.mark.parametrize("name", FILES)
def test_files_are_read_as_duckdb_reads_them(spark, tmp_path, name):
    path = tmp_path / "a.csv"
    path.write_bytes(FILES[name].encode())
    want = duckdb.sql(f"SELECT * FROM read_csv('{path}', auto_detect=true)")
    got = readers.read_csv(spark, str(path))
    assert [TYPES[t] for _, t in got.dtypes[1:]] == ["VARCHAR" if str(t) == "TIME" else str(t) for t in want.types]
    assert got.columns[1:] == want.columns
    assert [tuple(r)[1:] for r in got.orderBy("_row_id").collect()] == [tuple(map(plain, r)) for r in want.fetchall()]
    assert sorted(r._row_id for r in got.collect()) == list(range(1, got.count() + 1))


def test_given_dialects_are_kept(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a;b~1\nx;y~2\n")
    got = readers.read_csv(spark, str(path), header=False, delimiter="~")
    assert [tuple(r) for r in got.orderBy("_row_id").collect()] == [(1, "a;b", 1), (2, "x;y", 2)]


def test_ragged_rows_and_blank_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿a,b\n1,2\n\n3\n4,5,6\n7,8\n")
    got = readers.read_csv(spark, str(path))
    assert got.columns == ["_row_id", "a", "b"]
    assert [tuple(r) for r in got.orderBy("_row_id").collect()] == [(1, 1, 2), (2, 3, None), (3, 4, 5), (4, 7, 8)]


def test_breaks_across_many_splits(spark, tmp_path):
    """Records with line breaks in two files, each read in many splits; rows keep the order of the files."""
    rows = [(i, f"line {i}\n" * (i % 4) + ("x" * (i % 50))) for i in range(400)]
    text = "n,t\n" + "".join(f'{i},"{t}"\n' if t else f"{i},plain\n" for i, t in rows)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [tuple(r) for r in readers.read_csv(spark, str(tmp_path)).orderBy("_row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k, i, t or "plain") for k, (i, t) in enumerate(rows * 2, 1)]


def test_an_unclosed_quote_is_read_line_by_line(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('n,t\n1,"open\n2,b\n3,c\n')
    got = readers.read_csv(spark, str(path), header=True, delimiter=",", quote='"')
    assert got.count() == 3 and [r.n for r in got.orderBy("_row_id").collect()] == [1, 2, 3]


def test_an_empty_file_has_no_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["_row_id"] and got.count() == 0


@pytest.mark.parametrize(
    "texts, kind",
    [
        (["1", "2.5"], "DOUBLE"), (["1", "x"], "VARCHAR"), (["9223372036854775808"], "DOUBLE"), (["24:00:00"], "VARCHAR"), (["10:61"], "VARCHAR"),
        (["2024-02-30"], "VARCHAR"), (["2024", "2024-1"], "VARCHAR"), (["1d"], "VARCHAR"), (["inf"], "VARCHAR"), (["13/13/2024"], "VARCHAR"),
        (["31/12/2024", "12/31/2024"], "VARCHAR"), (["2024-01-01", "2024-01-01 10:00:00"], "TIMESTAMP"), (["", None], "VARCHAR"), (["yes", "1"], "VARCHAR"),
    ],
)
def test_kinds(spark, texts, kind):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = kind_of(df.agg(kinds_met(F.col("t"))).first()[0])
    assert got[0] == kind
    assert df.where(F.trim("t") != "").where(as_kind(F.col("t"), *got).isNull()).count() == 0


def test_even_splits_win():
    assert dialect.guess(["a,b;c", "1,2;3", "4,5,6;7"])[0] == ";"
    assert dialect.guess(["it's;fine", "x;y's"])[:2] == (";", '"')
    assert dialect.guess(["one", "two"])[0] == ","
