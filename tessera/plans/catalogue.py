"""The registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ROW_ID
from ..functions.storage import fresh_path
from ..functions.types import convert, spark_type
from ..operators import columns, edits, explore, filters, places, stats, tables
from ..operators.catalog import Catalog
from ..sources import readers, sqlite, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *skip: str) -> DataFrame:
    """Computed doubles to four places, without negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 4) + 0.0).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes])


# --- summaries and statistics -------------------------------------------------

_SEVEN = ("COUNT({c}) AS {c}_N, round(AVG({c}), 4) + 0 AS {c}_Mean, round(STDDEV_SAMP({c}), 4) + 0 AS {c}_Std, round(MIN({c}), 4) + 0 AS {c}_Min, "
          "round(MAX({c}), 4) + 0 AS {c}_Max, round(SUM({c}), 4) + 0 AS {c}_Sum, round(MEDIAN({c}), 4) + 0 AS {c}_Median")  # fmt: skip


@query("summary_grouped", "SELECT l_returnflag, l_linestatus, " + ", ".join(_SEVEN.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem GROUP BY ALL")
def _(spark, d):
    return rounded(tables.summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]))


@query("summary_global", "SELECT " + _SEVEN.format(c="c_acctbal") + " FROM customer")
def _(spark, d):
    return rounded(tables.summary(table(spark, d, "customer"), ["c_acctbal"]))


@query("summary_groups_only", "SELECT p_brand, p_type FROM part GROUP BY ALL")
def _(spark, d):
    return tables.summary(table(spark, d, "part"), [], ["p_brand", "p_type"], [])


@query("summary_null_group", "SELECT nullif(c_nationkey % 5, 0) AS g, COUNT(c_acctbal) AS c_acctbal_N, MIN(c_mktsegment) AS c_mktsegment_Min, COUNT(c_mktsegment) AS c_mktsegment_N, MIN(c_acctbal) AS c_acctbal_Min FROM customer GROUP BY ALL")
def _(spark, d):
    df = table(spark, d, "customer").withColumn("g", F.nullif(F.col("c_nationkey") % 5, F.lit(0)))
    return tables.summary(df, ["c_acctbal", "c_mktsegment"], ["g"], ["n", "min", "unknown"])


def _stats_sql(column: str, source: str) -> str:
    return (f"SELECT '{column}' AS column_name, COUNT(*) AS count, COUNT(*) - COUNT({column}) AS missing, round(AVG({column}), 4) + 0 AS mean, round(MEDIAN({column}), 4) + 0 AS median, "
            f"round(STDDEV_SAMP({column}), 4) + 0 AS std_dev, round(MIN({column})::DOUBLE, 4) + 0 AS min, round(MAX({column})::DOUBLE, 4) + 0 AS max, round(QUANTILE_CONT({column}, 0.25), 4)::DOUBLE + 0 AS q1, "
            f"round(QUANTILE_CONT({column}, 0.75), 4)::DOUBLE + 0 AS q3, COUNT(DISTINCT {column}) AS unique_count FROM {source}")  # fmt: skip


@query("column_stats", _stats_sql("o_totalprice", "orders"))
def _(spark, d):
    return rounded(stats.column_stats(table(spark, d, "orders"), "o_totalprice"))


@query("descriptive_stats", " UNION ALL ".join(_stats_sql(c, "customer") for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def _(spark, d):
    return rounded(stats.descriptive_stats(table(spark, d, "customer")))


@query("descriptive_stats_missing", " UNION ALL ".join(_stats_sql(c, "(SELECT nullif(l_linenumber, 3) AS a, l_quantity AS b FROM lineitem)") for c in ("a", "b")))
def _(spark, d):
    return rounded(stats.descriptive_stats(table(spark, d, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("a"), F.col("l_quantity").alias("b"))))


_BLOCK = "(SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5)"


@query("selection_stats", f"SELECT COUNT(*) AS count, round(SUM(x), 4) AS sum, round(AVG(x), 4) AS avg, round(MIN(x), 4) AS min, round(MAX(x), 4) AS max FROM (SELECT s_suppkey::DOUBLE AS x FROM {_BLOCK} UNION ALL SELECT s_nationkey FROM {_BLOCK} UNION ALL SELECT s_acctbal FROM {_BLOCK})")
def _(spark, d):
    ranked = readers.numbered(table(spark, d, "supplier").select("s_name", "s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey")
    return rounded(stats.selection_stats(filters.slice_block(ranked, 5, 1, 2, 4)))


@query("selection_stats_text", "SELECT COUNT(*) AS count, NULL::DOUBLE AS sum, NULL::DOUBLE AS avg, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM (SELECT p_name FROM part UNION ALL SELECT p_partkey::VARCHAR FROM part)")
def _(spark, d):
    return stats.selection_stats(table(spark, d, "part").select("p_name", "p_partkey"))


@query("describe_dataset", "SELECT 0 AS col_index, 'c_custkey' AS col_name, 'INTEGER' AS col_type, COUNT(*) AS row_count, 0::BIGINT AS missing_count FROM customer UNION ALL SELECT 1, 'c_name', 'VARCHAR', COUNT(*), 0 FROM customer UNION ALL SELECT 2, 'c_nationkey', 'INTEGER', COUNT(*), COUNT_IF(c_nationkey = 1)::BIGINT FROM customer")
def _(spark, d):
    return stats.describe_dataset(table(spark, d, "customer").select(F.col("c_custkey").cast("int"), "c_name", F.nullif(F.col("c_nationkey").cast("int"), F.lit(1)).alias("c_nationkey")))


@query("dataset_counts", "SELECT COUNT(*) AS row_count, 6 AS col_count FROM orders")
def _(spark, d):
    return stats.dataset_counts(table(spark, d, "orders"))


# --- sort, page, subset, filters ------------------------------------------------


@query("sort_multi", "SELECT row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_retailprice NULLS LAST, p_partkey) AS _row_id, * FROM part")
def _(spark, d):
    return tables.sort(table(spark, d, "part"), ["p_size", "p_retailprice", "p_partkey"], ["DESC", "asc", "asc"])


@query("sort_nulls_last", "SELECT row_number() OVER (ORDER BY x DESC NULLS LAST, c_custkey) AS _row_id, * FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS x FROM customer)")
def _(spark, d):
    return tables.sort(table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("x")), ["x", "c_custkey"], ["desc", "asc"])


@query("row_ids", "SELECT row_number() OVER (ORDER BY event_id) AS _row_id, event_id, user_id FROM events")
def _(spark, d):
    return readers.numbered(table(spark, d, "events").select("event_id", "user_id"), "event_id")


@query("page", "SELECT o_orderkey AS _row_id, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return tables.page(table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_totalprice", "o_custkey"), 2, 50, "o_totalprice", "desc")


@query("page_deep", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40 OFFSET (SELECT COUNT(*) // 2 // 40 * 40 FROM lineitem)")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    whole = places.ordered(df, F.col("l_extendedprice").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber"))
    return whole.page(whole.rows // 2 // 40, 40)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, d):
    return tables.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))


@query("subset_rows_cols", "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_discount > 0.05 AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1995-01-01'")
def _(spark, d):
    return tables.subset(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"], "l_discount > 0.05 AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1995-01-01'")


@query("filter_discrete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE coalesce(nullif(o_orderstatus, 'O'), '') IN ('', 'F')")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    return df.where(filters.discrete("s", ["", "F"])).select("o_orderkey", "o_orderstatus")


@query("filter_discrete_typed", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE (l_linenumber IN (2, 5)) AND l_returnflag IN ('A', 'R') AND l_shipdate::DATE IN (DATE '1995-03-05', DATE '1996-02-12', DATE '1997-07-01')")
def _(spark, d):
    df = table(spark, d, "lineitem")
    wanted = {"l_linenumber": ["2", "05", "5", ""], "l_returnflag": ["A", "R"], "l_shipdate": ["1995-03-05", "1996-02-12", "1997-7-1", "1997-07-01"]}
    dates = df.withColumns({"moment": F.col("l_shipdate"), "l_shipdate": F.col("l_shipdate").cast("date")})
    found = dates.where(filters.all_of([filters.discrete(c, v, dates.schema[c].dataType) for c, v in wanted.items()]))
    return found.select("l_orderkey", "l_linenumber", F.col("moment").alias("l_shipdate"))


@query("filter_discrete_large", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    wanted = table(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey")
    return filters.discrete_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", wanted)


@query("filter_range", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20.5")
def _(spark, d):
    return table(spark, d, "lineitem").where(filters.value_range("l_quantity", "10", 20.5)).select("l_orderkey", "l_quantity")


@query("filter_both", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 40 AND l_returnflag IN ('N')")
def _(spark, d):
    both = filters.all_of([filters.value_range("l_quantity", 40, "x"), filters.discrete("l_returnflag", ["N"])])
    return table(spark, d, "lineitem").where(both).select("l_orderkey", "l_quantity", "l_returnflag")


@query("filter_counts", "SELECT COUNT_IF(l_tax <= 0.02)::BIGINT AS filtered, COUNT(*) AS total FROM lineitem")
def _(spark, d):
    return filters.filter_counts(table(spark, d, "lineitem"), [filters.value_range("l_tax", None, 0.02)])


@query("distinct_values", "SELECT DISTINCT coalesce(CAST(nullif(p_size, 7) AS VARCHAR), '') AS value FROM part")
def _(spark, d):
    return filters.distinct_values(table(spark, d, "part").select(F.nullif("p_size", F.lit(7)).alias("p_size")), "p_size")


@query("slice_block", "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS k FROM part) WHERE k BETWEEN 3 AND 108")
def _(spark, d):
    return filters.slice_block(readers.numbered(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey"), 108, 3, 1, 2)


@query("slice_block_gaps", "SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 1) WHERE k BETWEEN 11 AND 120")
def _(spark, d):
    df = table(spark, d, "orders").where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias(ROW_ID), "o_orderstatus", "o_custkey", "o_totalprice")
    return filters.slice_block(df, 120, 11, 3, 2)


# --- joins and updates ------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return tables.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "inner")


@query("join_left", "SELECT c_custkey, x, n_nationkey, n_name FROM (SELECT c_custkey, c_nationkey + 5 AS x FROM customer) LEFT JOIN nation ON x = n_nationkey")
def _(spark, d):
    return tables.join(table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 5).alias("x")), table(spark, d, "nation").select("n_nationkey", "n_name"), "x", "n_nationkey", "left")


@query("join_right", "SELECT l_orderkey, l_quantity, o_orderkey, o_totalprice FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    return tables.join(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "l_orderkey", "o_orderkey", "right")


@query("join_full", "SELECT a.k, a.s_name, b.k AS k_r, b.s_name AS s_name_r FROM (SELECT s_suppkey AS k, s_name FROM supplier) a FULL JOIN (SELECT nullif(s_suppkey + 20, 30) AS k, s_name FROM supplier) b ON a.k = b.k")
def _(spark, d):
    s = table(spark, d, "supplier")
    return tables.join(s.select(F.col("s_suppkey").alias("k"), "s_name"), s.select(F.nullif(F.col("s_suppkey") + 20, F.lit(30)).alias("k"), "s_name"), "k", "k", "full")


@query("update_keyed", "SELECT c_custkey, CASE WHEN r.k IS NOT NULL THEN r.seg ELSE c_mktsegment END AS c_mktsegment, CASE WHEN r.k IS NOT NULL THEN r.bal ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT c_custkey * 3 AS k, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal + 1 AS bal FROM customer) r ON c_custkey = r.k")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.select((F.col("c_custkey") * 3).alias("c_custkey"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return tables.update(c, new, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("update_duplicates", "SELECT n_nationkey, coalesce(m, n_name) AS n_name FROM nation LEFT JOIN (SELECT c_nationkey AS k, arg_max(c_name, c_custkey) AS m FROM customer WHERE c_nationkey > 4 GROUP BY 1) ON k = n_nationkey")
def _(spark, d):
    new = table(spark, d, "customer").where("c_nationkey > 4").select(F.col("c_custkey").alias(ROW_ID), F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    return tables.update(table(spark, d, "nation").select("n_nationkey", "n_name"), new, "n_nationkey", ["n_name"])


# --- concatenate and reshape --------------------------------------------------------


@query("concat_same", "SELECT * FROM part UNION ALL SELECT * FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return tables.concatenate([p, p])


@query("concat_missing_cols", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tables.concatenate([c, s])


@query("concat_widen", "SELECT n_regionkey::DOUBLE AS a, n_nationkey::VARCHAR AS b FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier")
def _(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))
    return tables.concatenate([a, table(spark, d, "supplier").select(F.col("s_acctbal").alias("a"), F.col("s_name").alias("b"))])


@query("stack_numeric", "SELECT p_partkey, 'p_size' AS \"Label\", p_size::DOUBLE AS \"Value\" FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(spark, d):
    return tables.stack(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


@query("stack_mixed", "SELECT s_suppkey, 's_name' AS \"Label\", s_name AS \"Value\" FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', nullif(s_nationkey, 2)::VARCHAR FROM supplier")
def _(spark, d):
    return tables.stack(table(spark, d, "supplier").withColumn("s_nationkey", F.nullif("s_nationkey", F.lit(2))), ["s_name", "s_nationkey"], ["s_suppkey"])


@query("stack_numbered", "SELECT row_number() OVER (ORDER BY p, c_custkey) AS _row_id, c_name, \"Label\", \"Value\" FROM (SELECT 1 AS p, c_custkey, c_name, 'c_custkey' AS \"Label\", c_custkey::BIGINT AS \"Value\" FROM customer UNION ALL SELECT 2, c_custkey, c_name, 'c_nationkey', c_nationkey FROM customer)")
def _(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"))
    return tables.stack(readers.numbered(df, "c_custkey"), ["c_custkey", "c_nationkey"], ["c_name"], number_rows=True)



def _split_sql(source: str, ids: str, labels) -> str:
    cells = ", ".join(f"MAX(CASE WHEN s = '{x}' THEN v END) AS \"{x}\"" for x in labels)
    return f"SELECT {ids}, {cells} FROM (SELECT *, row_number() OVER (PARTITION BY {ids}, s ORDER BY r) AS n FROM ({source})) GROUP BY {ids}, n"


@query("split_basic", _split_sql("SELECT p_size, CAST(p_partkey % 3 AS VARCHAR) AS s, p_name AS v, p_partkey AS r FROM part", "p_size", ("0", "1", "2")))
def _(spark, d):
    return tables.split(table(spark, d, "part").select(F.col("p_partkey").alias(ROW_ID), "p_size", (F.col("p_partkey") % 3).cast("string").alias("s"), F.col("p_name").alias("v")), "s", "v")


@query("split_duplicates", _split_sql("SELECT c_nationkey, c_mktsegment AS s, c_acctbal AS v, c_custkey AS r FROM customer", "c_nationkey", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
def _(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_nationkey", F.col("c_mktsegment").alias("s"), F.col("c_acctbal").alias("v"))
    return tables.split(df, "s", "v", ["c_nationkey"])


@query("split_null_label", _split_sql("SELECT s_nationkey, nullif(CAST(s_suppkey % 3 AS VARCHAR), '0') AS s, s_acctbal AS v, s_suppkey AS r FROM supplier", "s_nationkey", ("1", "2")))
def _(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias(ROW_ID), "s_nationkey", F.nullif((F.col("s_suppkey") % 3).cast("string"), F.lit("0")).alias("s"), F.col("s_acctbal").alias("v"))
    return tables.split(df, "s", "v", ["s_nationkey"])


_PRIORITIES = "(SELECT o_orderpriority, COUNT(*) AS n, row_number() OVER (ORDER BY o_orderpriority) AS k FROM orders GROUP BY 1)"


@query("transpose", "SELECT 'o_orderpriority' AS \"Label\", " + ", ".join(f"MAX(CASE WHEN k = {i} THEN o_orderpriority END) AS Row{i}" for i in range(1, 6)) + f" FROM {_PRIORITIES} UNION ALL SELECT 'n', " + ", ".join(f"MAX(CASE WHEN k = {i} THEN n::VARCHAR END)" for i in range(1, 6)) + f" FROM {_PRIORITIES}")
def _(spark, d):
    counted = tables.summary(table(spark, d, "orders").withColumn("n", F.lit(1)), ["n"], ["o_orderpriority"], ["n"]).withColumnRenamed("n_N", "n")
    return tables.transpose(readers.numbered(counted, "o_orderpriority"))


@query("transpose_tiles", "SELECT label AS \"Label\", k // 1000 AS block, string_agg(v, '|' ORDER BY k) AS cells FROM (SELECT 'o_orderkey' AS label, CAST(o_orderkey AS VARCHAR) AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 FROM orders) GROUP BY 1, 2")
def _(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_orderkey", "o_orderstatus")
    return tables.transpose_tiles(df).select("Label", "block", F.array_join("cells", "|").alias("cells"))


# --- column operations --------------------------------------------------------------


@query("change_type_ok", "SELECT o_orderkey, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS x FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("x"))
    return columns.change_type(df, {"x": "DOUBLE"})


@query("change_type_report", "SELECT 'o_orderpriority' AS column_name, 'INTEGER' AS target, COUNT_IF(TRY_CAST(o_orderpriority AS INTEGER) IS NULL)::BIGINT AS failed FROM orders UNION ALL SELECT 'o_custkey', 'DOUBLE', 0 FROM region WHERE r_regionkey = 0")
def _(spark, d):
    return columns.conversion_failures(table(spark, d, "orders"), {"o_orderpriority": "INTEGER", "o_custkey": "DOUBLE"})


@query("convert_rounding", "SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS a, CAST(o_orderkey / 2 AS INTEGER) AS b, o_orderkey // 2 + CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END AS c FROM orders")
def _(spark, d):
    half = F.col("o_orderkey") / 2
    text, dbl = spark_type("VARCHAR"), spark_type("DOUBLE")
    return table(spark, d, "orders").select("o_orderkey", convert(F.col("o_totalprice"), dbl, "INTEGER").alias("a"), convert(half, dbl, "INTEGER").alias("b"), convert(half.cast("string"), text, "BIGINT").alias("c"))


_TEXTS = {"1d": None, "1f": None, " 5 ": 5.0, "+5": 5.0, "1_000": 1000.0, "0x10": 16.0, "0b11": 3.0, "5.5": 6.0, "-2.5": -3.0, "1e3": 1000.0, "": None, "1 2": None}


@query("convert_texts", "SELECT p_partkey, TRY_CAST(t AS INTEGER) AS i, TRY_CAST(t AS BIGINT) AS b, TRY_CAST(t AS DOUBLE) AS x, CAST(TRY_CAST(u AS DATE) AS VARCHAR) AS d, TRY_CAST(u AS TIMESTAMP) AS ts FROM (SELECT p_partkey, [" + ", ".join(f"'{t}'" for t in _TEXTS) + "][1 + p_partkey % 12] AS t, ['2024', '2024-1', '2024-1-5', '2024/01/05', '2024-02-30', '01/02/2024', '2024-01-05 10:00:00', 'x'][1 + p_partkey % 8] AS u FROM part)")
def _(spark, d):
    k, text = F.col("p_partkey"), spark_type("VARCHAR")
    t = F.element_at(F.array(*map(F.lit, _TEXTS)), (k % 12 + 1).cast("int"))
    u = F.element_at(F.array(*map(F.lit, ("2024", "2024-1", "2024-1-5", "2024/01/05", "2024-02-30", "01/02/2024", "2024-01-05 10:00:00", "x"))), (k % 8 + 1).cast("int"))
    kinds = {"i": (t, "INTEGER"), "b": (t, "BIGINT"), "x": (t, "DOUBLE"), "d": (u, "DATE"), "ts": (u, "TIMESTAMP")}
    return table(spark, d, "part").select("p_partkey", *[(convert(c, text, kind).cast("string") if kind == "DATE" else convert(c, text, kind)).alias(n) for n, (c, kind) in kinds.items()])


@query("detect_types", "SELECT unnest(['event_id', 'value', 'event_type', 'flag', 'day', 'blank']) AS column_name, unnest(['INTEGER', 'DOUBLE', 'VARCHAR', 'BOOLEAN', 'DATE', 'VARCHAR']) AS detected")
def _(spark, d):
    df = table(spark, d, "events")
    flag = F.when(F.col("event_id") % 2 == 0, "yes").otherwise("True")
    return columns.detect_types(df.select(F.col("event_id").cast("string"), F.col("value").cast("string"), "event_type", flag.alias("flag"), F.date_format("ts", "yyyy/M/d").alias("day"), F.lit(" ").alias("blank")))


@query("validate", "SELECT 'event_type' AS column_name, COUNT_IF(NOT regexp_full_match(event_type, '-?[0-9]+'))::BIGINT AS n_invalid, MIN(event_type) AS sample FROM events UNION ALL SELECT 'half', COUNT_IF(event_id % 2 = 1)::BIGINT, MIN(CASE WHEN event_id % 2 = 1 THEN CAST(event_id / 2 AS VARCHAR) END) FROM events")
def _(spark, d):
    half = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") / 2).cast("long").cast("string")).otherwise((F.col("event_id") / 2).cast("string"))
    return columns.validate(table(spark, d, "events").select("event_type", half.alias("half")), {"event_type": "INTEGER", "half": "INTEGER"})


@query("format_fixed", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.3f', l_quantity) AS l_quantity FROM lineitem")
def _(spark, d):
    return columns.format_columns(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), {"l_quantity": {"kind": "fixed", "decimals": 3}})


@query("format_fractions", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x * 8 = floor(x * 8) AND floor(x * 8)::BIGINT % 2 = 1 THEN printf('%.2f', x + 0.001) ELSE printf('%.2f', x) END AS x FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DOUBLE * 0.37::DOUBLE AS x FROM lineitem)")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice").cast("double") * F.lit(0.37)).alias("x"))
    return columns.format_columns(df, {"x": {"kind": "fixed"}})


@query("format_percent", "SELECT p_partkey, printf('%.1f', p_size * 100.0) || '%' AS p_size FROM part")
def _(spark, d):
    return columns.format_columns(table(spark, d, "part").select("p_partkey", "p_size"), {"p_size": {"kind": "percent", "decimals": 1}})


#: Currency code -> symbol, for the SQL.
_SYMBOLS = {"CNY": "¥", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "KRW": "₩", "HKD": "HK$", "TWD": "NT$"}


@query("format_currency", "SELECT o_orderkey, " + ", ".join(f"'{symbol}' || printf('%.2f', o_custkey::DOUBLE) AS {code}" for code, symbol in _SYMBOLS.items()) + ", '' AS gone, o_orderstatus FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", *[F.col("o_custkey").alias(code) for code in _SYMBOLS], F.lit(None).cast("double").alias("gone"), "o_orderstatus")
    return columns.format_columns(df, {code: {"kind": "currency", "currency": code} for code in _SYMBOLS} | {"gone": {"kind": "fixed"}, "o_orderstatus": {"kind": "currency", "currency": "USD"}})


@query("format_scientific", "SELECT c_custkey, CASE WHEN x = 0 THEN '0e+0' WHEN x < 10 THEN x || 'e+3' WHEN x % 10 = 0 THEN (x // 10) || 'e+4' ELSE (x // 10) || '.' || (x % 10) || 'e+4' END AS x FROM (SELECT c_custkey, c_custkey % 100 AS x FROM customer)")
def _(spark, d):
    return columns.format_columns(table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100 * 1000.0).alias("x")), {"x": {"kind": "scientific"}})


@query("add_col", "SELECT *, NULL::DOUBLE AS score, NULL::VARCHAR AS \"列1\" FROM supplier")
def _(spark, d):
    return columns.add_columns(columns.add_column(table(spark, d, "supplier"), "score", "DOUBLE"), 1)


@query("drop_col", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return columns.delete_column(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_name")


@query("rename_col", "SELECT s_suppkey, s_name AS \"full name\", s_acctbal FROM supplier")
def _(spark, d):
    return columns.rename_column(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_name", "full name")


# --- edits ------------------------------------------------------------------------------


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_name", "c_acctbal", "c_nationkey")


_CUSTOMERS = "(SELECT c_custkey AS _row_id, c_name, c_acctbal, c_nationkey FROM customer)"


@query("append_rows", f"SELECT * FROM {_CUSTOMERS} UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + i, NULL, NULL, NULL FROM range(1, 4) t(i)")
def _(spark, d):
    return edits.append_rows(_customers(spark, d), 3)


_APPLIED = f"SELECT _row_id, CASE WHEN _row_id % 10 = 0 THEN NULL WHEN _row_id % 10 = 1 THEN 'new' ELSE c_name END AS c_name, CASE WHEN _row_id % 10 = 2 THEN _row_id + 0.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN _row_id % 10 = 4 THEN NULL ELSE c_nationkey END AS c_nationkey FROM {_CUSTOMERS}"


def _cell_edits(spark, d) -> tuple[DataFrame, DataFrame]:
    c = _customers(spark, d)
    k = F.col(ROW_ID)
    edit = lambda m, column, value, seq: F.struct(F.lit(m).alias("m"), F.lit(column).alias("column"), value.alias("value"), F.lit(seq).alias("seq"))
    cells = F.array(
        edit(0, "c_name", F.lit(""), 1), edit(1, "c_name", F.lit("old"), 1), edit(1, "c_name", F.lit("new"), 2), edit(2, "c_acctbal", (k + 0.5).cast("string"), 1),
        edit(3, "c_nationkey", F.lit("no number"), 1), edit(4, "no column", F.lit("x"), 1), edit(4, "c_nationkey", F.lit(""), 1), edit(5, "c_acctbal", F.lit("1d"), 1),
    )
    return c, c.select(ROW_ID, F.inline(cells)).where(k % 10 == F.col("m")).select(ROW_ID, "column", "value", "seq")


@query("apply_edits", _APPLIED)
def _(spark, d):
    return edits.apply_cell_edits(*_cell_edits(spark, d))


@query("rejected_edits", f"SELECT _row_id, CASE _row_id % 10 WHEN 3 THEN 'c_nationkey' WHEN 4 THEN 'no column' ELSE 'c_acctbal' END AS \"column\", CASE _row_id % 10 WHEN 3 THEN 'no number' WHEN 4 THEN 'x' ELSE '1d' END AS value, CASE _row_id % 10 WHEN 4 THEN 'no such column' WHEN 3 THEN 'no INTEGER' ELSE 'no DOUBLE' END AS reason FROM {_CUSTOMERS} WHERE _row_id % 10 IN (3, 4, 5)")
def _(spark, d):
    return edits.rejected_edits(*_cell_edits(spark, d)).drop("seq")


@query("delete_rows", f"SELECT * FROM {_CUSTOMERS} WHERE _row_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, d):
    return edits.delete_rows(_customers(spark, d), table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("patch_block", "WITH b AS (SELECT c_custkey AS _row_id, c_name, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS k, COUNT(*) OVER () AS n, MAX(c_custkey) OVER () AS top FROM customer), p AS (SELECT row_number() OVER (ORDER BY s_suppkey) + 22 AS k, CASE WHEN s_suppkey = 1 THEN '' ELSE s_name END AS a, s_suppkey + 100 AS c FROM supplier) SELECT coalesce(_row_id, p.k - (SELECT MAX(n) FROM b) + (SELECT MAX(top) FROM b))::BIGINT AS _row_id, coalesce(nullif(a, ''), c_name) AS name, coalesce(c, c_nationkey)::BIGINT AS c_nationkey FROM b FULL JOIN p ON b.k = p.k")
def _(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias(ROW_ID), "c_name", F.col("c_nationkey").cast("long"))
    patch = table(spark, d, "supplier").select(F.col("s_suppkey").alias(ROW_ID), F.when(F.col("s_suppkey") == 1, "").otherwise(F.col("s_name")).alias("a"), (F.col("s_suppkey") + 100).cast("string").alias("c"))
    return edits.patch_block(base, patch, 23, 1, ["VARCHAR", "BIGINT"], ["name", ""])


_INSIDE = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) BETWEEN 11 AND 10 + (SELECT COUNT(*) FROM customer) AS inside FROM orders)"


@query("check_patch", f"SELECT 'o_orderstatus' AS column_name, TRUE AS compatible, COUNT_IF(inside AND o_orderstatus <> 'F')::BIGINT AS conflicts FROM {_INSIDE} UNION ALL SELECT 'o_custkey', COUNT(o_custkey) = 0, COUNT_IF(inside)::BIGINT FROM {_INSIDE} UNION ALL SELECT 'empty', COUNT(*) >= 0, 0 FROM {_INSIDE}")
def _(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), "o_custkey", F.lit(None).cast("double").alias("empty"))
    patch = table(spark, d, "customer").select(F.col("c_custkey").alias(ROW_ID), F.lit("x").alias("a"), F.lit("1.5").alias("b"), F.lit("y").alias("c"))
    return edits.check_patch(base, patch, 11, 1, ["VARCHAR", "DOUBLE", "VARCHAR"])


# --- round trips ---------------------------------------------------------------------------


@query("csv_roundtrip", "SELECT * FROM orders")
def _(spark, d):
    df = table(spark, d, "orders")
    path = fresh_path(spark, "csv")
    writers.write_csv(df, path)
    return readers.read_csv(spark, path, header=True, schema=df.schema, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").drop(ROW_ID)


@query("tsv_roundtrip", "SELECT CAST(s_suppkey AS VARCHAR) AS c1, s_name AS c2, CAST(s_nationkey AS VARCHAR) AS c3, CAST(s_acctbal AS VARCHAR) AS c4 FROM supplier")
def _(spark, d):
    path = fresh_path(spark, "tsv")
    writers.write_tsv(table(spark, d, "supplier"), path)
    return readers.read_tsv(spark, path).drop(ROW_ID)


@query("copy_block", "SELECT s_suppkey || chr(9) || s_name AS value FROM supplier WHERE s_suppkey BETWEEN 1 AND 89")
def _(spark, d):
    return writers.tsv_lines(filters.slice_block(readers.numbered(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey"), 2, 90, 1, 2))


@query("project_roundtrip", "SELECT * FROM customer")
def _(spark, d):
    path = fresh_path(spark, "project")
    writers.save_project(spark, "p", {"a": table(spark, d, "customer"), "b": table(spark, d, "region")}, path)
    return writers.open_project(spark, path)["a"]


@query("sqlite_roundtrip", "SELECT row_number() OVER () AS _row_id, s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM (SELECT * FROM supplier ORDER BY s_suppkey)")
def _(spark, d):
    folder = urlparse(fresh_path(spark, "sqlite")).path  # SQLite itself opens the files, one for each partition
    sqlite.export_sqlite({"supplier": table(spark, d, "supplier").orderBy("s_suppkey")}, folder, shards=True)
    return sqlite.read_sqlite(spark, folder)["supplier"]


@query("snapshot_restore", "SELECT s_suppkey AS _row_id, s_name FROM supplier")
def _(spark, d):
    catalog = Catalog(spark)
    catalog.materialize(table(spark, d, "supplier").select(F.col("s_suppkey").alias(ROW_ID), "s_name"), "s")
    catalog.snapshot("first")
    catalog.materialize(catalog.get("s").where("false"), "s")
    catalog.restore("first")
    return catalog.get("s")


@query("version_undo", "SELECT c_custkey AS _row_id, c_name FROM customer WHERE c_custkey > 3")
def _(spark, d):
    catalog = Catalog(spark)
    base = table(spark, d, "customer").select(F.col("c_custkey").alias(ROW_ID), "c_name")
    catalog.materialize(base, "c")
    catalog.record("import")
    catalog.materialize(base.where(f"{ROW_ID} > 3"), "c")
    catalog.record("delete")
    catalog.undo()
    catalog.redo()
    return catalog.get("c")


@query("version_deltas", "SELECT o_orderkey AS _row_id, CASE WHEN o_orderkey % 50 = 1 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 70 = 1 THEN 0.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 90 <> 2")
def _(spark, d):
    catalog = Catalog(spark)
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_orderstatus", "o_totalprice")
    catalog.materialize(base, "orders")
    catalog.record("import")
    cell = lambda m, column, value: base.where(F.col(ROW_ID) % m == 1).select(ROW_ID, F.lit(column).alias("column"), F.lit(value).alias("value"))
    catalog.edit("orders", cell(50, "o_orderstatus", "changed").unionAll(cell(90, "o_totalprice", "no number")))
    catalog.record("status")
    catalog.edit("orders", cell(70, "o_totalprice", "0.5"))
    catalog.delete_rows("orders", base.where(F.col(ROW_ID) % 90 == 2).select(ROW_ID))
    catalog.record("prices")
    catalog.jump(0)
    catalog.jump(2)
    return catalog.get("orders")


@query("restore_one_table", "SELECT 'customer' AS of, COUNT(*) AS n FROM customer UNION ALL SELECT 'orders', 0")
def _(spark, d):
    catalog = Catalog(spark)
    for name in ("customer", "orders"):
        catalog.materialize(table(spark, d, name).select(F.monotonically_increasing_id().alias(ROW_ID), F.lit(name).alias("of")), name)
    catalog.snapshot("first")
    for name in ("customer", "orders"):
        catalog.materialize(catalog.get(name).where("false"), name)
    catalog.restore("first", only="customer")
    path = fresh_path(spark, "catalog")
    catalog.save(path)
    return Catalog.load(spark, path).described().select(F.col("name").alias("of"), F.col("row_count").alias("n"))


@query("dataset_list", "SELECT 'p' AS name, 'csv' AS source_type, COUNT(*) AS row_count, 2 AS col_count FROM part UNION ALL SELECT 's', 'manual', COUNT(*), 1 FROM supplier")
def _(spark, d):
    catalog = Catalog(spark)
    catalog.materialize(table(spark, d, "part").select(F.col("p_partkey").alias(ROW_ID), "p_name", "p_size"), "part", "csv")
    catalog.materialize(table(spark, d, "supplier").select(F.col("s_suppkey").alias(ROW_ID), "s_name"), "s")
    catalog.rename("part", "p")
    catalog.materialize(catalog.get("s"), "gone")
    catalog.drop("gone")
    return catalog.described()


@query("project_snapshots", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 5")
def _(spark, d):
    path = fresh_path(spark, "project")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    writers.save_project(spark, "p", {"s": s}, path, snapshots={"before": {"s": s.where("s_suppkey > 5")}})
    return writers.open_snapshots(spark, path)["before"]["s"]


@query("export_all", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    path = fresh_path(spark, "all")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_orderkey", "o_orderstatus")
    writers.export_all_csv({"all/orders": orders, "suppliers": table(spark, d, "supplier").select("s_name")}, path)
    return readers.read_csv(spark, f"{path}/all_orders", schema=orders.drop(ROW_ID).schema).drop(ROW_ID)


@query("import_csv_infer", "SELECT row_number() OVER (ORDER BY p_partkey) AS _row_id, p_partkey::BIGINT AS p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def _(spark, d):
    path = fresh_path(spark, "csv")
    writers.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").orderBy("p_partkey"), path)
    return readers.read_csv(spark, path)


def _as_text(df: DataFrame, path: str, delimiter: str, header: str) -> str:
    """``df`` as lines of cells joined by ``delimiter``, in parts of its own order with a header each."""
    line = F.concat_ws(delimiter, *[F.col(c).cast("string") for c in df.columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    df.select(F.when(first, F.concat(F.lit(f"{header}\n"), line)).otherwise(line).alias("value")).write.text(path)
    return path


@query("import_csv_semicolon", "SELECT o_orderkey::BIGINT AS o_orderkey, replace(CAST(o_custkey AS VARCHAR) || '.5', '.', ',') AS amount, o_orderstatus FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(",5")).alias("amount"), "o_orderstatus")
    return readers.read_csv(spark, _as_text(df, fresh_path(spark, "csv"), ";", "o_orderkey;amount;o_orderstatus")).drop(ROW_ID)


@query("import_csv_times", "SELECT event_id::BIGINT AS event_id, strftime(ts::TIMESTAMP, '%H:%M:%S') AS at, strftime(ts::TIMESTAMP, '%Y-%m-%d') AS day, date_trunc('second', ts::TIMESTAMP) AS moment FROM events")
def _(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    df = table(spark, d, "events").select("event_id", F.date_format(ts, "HH:mm:ss").alias("at"), F.date_format(ts, "dd/MM/yyyy").alias("day"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("moment"))
    return readers.read_csv(spark, _as_text(df, fresh_path(spark, "csv"), "\t", "event_id\tat\tday\tmoment")).drop(ROW_ID).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("import_csv_breaks", "SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || chr(10) || '\"' || p_brand ELSE p_name END AS p_name FROM part")
def _(spark, d):
    path = fresh_path(spark, "csv")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit('\n"'), "p_brand")).otherwise(F.col("p_name"))
    writers.write_csv(table(spark, d, "part").select("p_partkey", name.alias("p_name")), path)
    return readers.read_csv(spark, path).drop(ROW_ID)


# --- exploration -------------------------------------------------------------------------------


def _shape_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, round((avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*pow(avg(x), 3)) / pow(var_pop(x), 1.5), 4) + 0 AS skewness, "
            f"round((avg(x*x*x*x) - 4*avg(x)*avg(x*x*x) + 6*pow(avg(x), 2)*avg(x*x) - 3*pow(avg(x), 4)) / pow(var_pop(x), 2) - 3, 4) + 0 AS kurtosis FROM (SELECT {c}::DOUBLE / 100 AS x FROM customer)")  # fmt: skip


@query("shape_stats", " UNION ALL ".join(_shape_sql(c) for c in ("c_acctbal", "c_nationkey")))
def _(spark, d):
    return rounded(explore.shape_stats(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"]))


@query("correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) + 0 AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))))
def _(spark, d):
    return rounded(explore.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("frequencies", "SELECT event_type AS value, COUNT(*) AS count, round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM events), 4) + 0 AS percent FROM events GROUP BY 1")
def _(spark, d):
    return rounded(explore.frequencies(table(spark, d, "events"), "event_type"))


@query("histogram", "WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem), n AS (SELECT least(floor((l_quantity - lo) / w)::INTEGER + 1, 7) AS bin, COUNT(*) AS count FROM lineitem, b GROUP BY 1) SELECT i::INTEGER AS bin, round(lo + (i - 1) * w, 4) + 0 AS low, coalesce(count, 0)::BIGINT AS count FROM range(1, 8) t(i) CROSS JOIN b LEFT JOIN n ON bin = i")
def _(spark, d):
    return rounded(explore.histogram(table(spark, d, "lineitem"), "l_quantity", 7))


@query("typed_filters", "SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_size <> 12 AND contains(p_type, 'A') AND p_brand IS NOT NULL")
def _(spark, d):
    tests = [("p_size", "gte", 10), ("p_size", "neq", 12), ("p_type", "contains", "A"), ("p_brand", "not_null", None)]
    return table(spark, d, "part").where(filters.all_of([explore.predicate(*t) for t in tests])).select("p_partkey", "p_name")


@query("fill_and_drop_missing", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1)::INTEGER AS a, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("a"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return explore.drop_missing(explore.fill_missing(df, {"a": -1}), ["c_acctbal"])


@query("computed_column", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) + 0 AS net FROM lineitem")
def _(spark, d):
    return rounded(explore.computed_column(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"), "net", "l_extendedprice * (1 - l_discount)").drop("l_extendedprice", "l_discount"))
