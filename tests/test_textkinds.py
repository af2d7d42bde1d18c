"""Kinds of texts: the work per cell, and calendar dates in every order."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import textkinds
from tessera.sources import readers


@pytest.mark.parametrize("kind, order, most", [("TIMESTAMP", "ymd4", 8), ("DATE", "dmy4", 3), ("DATE", "dmy2", 5), ("TIME", None, 4)])
def test_a_text_becomes_a_value_by_few_searches(spark, kind, order, most):
    """Spark repeats an expression at each of its uses; a timestamp once took 35 searches by pattern, a date 13."""
    df = spark.range(3).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("t"))
    plan = df.select(textkinds.as_kind(F.col("t"), kind, order).alias("v"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 0 < plan.count("regexp_") + plan.count("rlike(") <= most


def test_the_kinds_of_a_file_are_told_cell_by_cell(spark, tmp_path):
    """Types are told without one large expression per column: with it, many columns of dates made code that isn't compiled."""
    df = spark.range(40).select(*[F.format_string(f"{i % 28 + 1:02d}/%02d/2024", F.col("id") % 12 + 1).alias(f"c{i}") for i in range(60)])
    df = df.select(*[F.concat(F.col(c), F.lit(" 10:00:00")).alias(c) if i % 2 else F.col(c) for i, c in enumerate(df.columns)])
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "a"))
    got = readers.read_csv(spark, str(tmp_path / "a"))
    # Columns whose days are all 12 or less fit both orders, and the day goes first.
    assert [t for _, t in got.dtypes[1:]] == ["timestamp_ntz" if i % 2 else "date" for i in range(60)]
    first = got.where("_row_id = 1").first()
    assert [first[f"c{i}"] for i in (0, 27)] == [datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 28, 10)]
    assert textkinds.kinds_in(got.select(F.lit(None).cast("string").alias("a"), F.lit("x").alias("b"), F.col("c0").cast("string").alias("c")), [F.col("a"), F.col("b"), F.col("c")]) == [None, 0, 112]
    assert textkinds.kinds_in(spark.createDataFrame([], "a string"), [F.col("a")]) == [None]


CALENDAR = [
    ("2024-02-29", "ymd4", "2024-02-29"), ("2023-02-29", None, None), ("1900/2/29", None, None), ("2000.2.29", "ymd4", "2000-02-29"), ("0000-01-01", None, None),
    ("29 2 2024", "dmy4", "2024-02-29"), ("2/29/2024", "mdy4", "2024-02-29"), ("31/4/2024", None, None), ("4/31/2024", None, None), ("30-4-2024", "dmy4", "2024-04-30"),
    ("24-2-29", "ymd2", "2024-02-29"), ("31/1/69", "dmy2", "1969-01-31"), ("31/1/68", "dmy2", "2068-01-31"), ("1/31/7", "mdy2", "2007-01-31"), ("13/13/2024", None, None), ("024-1-1", None, None),
]


def test_days_of_the_calendar_in_every_order(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(CALENDAR)], "i int, t string")
    for clock, kind in (("", "DATE"), (" 12:30", "TIMESTAMP"), ("T12:30:15.5", "TIMESTAMP"), (" 12:30:00 AM", "TIMESTAMP"), (" 11:30pm", "TIMESTAMP")):
        texts = df.withColumn("t", F.concat("t", F.lit(clock)))
        masks = {r.i: r.m for r in texts.select("i", textkinds.kind_mask(F.col("t")).alias("m")).collect()}
        for i, (_, order, _) in enumerate(CALENDAR):
            assert (textkinds.kind_of(masks[i]) == (kind, order)) if order else masks[i] == 0
        assert textkinds.kinds_in(spark.range(2), [F.lit(x[0] + clock) for x in CALENDAR]) == [masks[i] for i in range(len(CALENDAR))]
        shown = {"": "", " 12:30": " 12:30:00", "T12:30:15.5": " 12:30:15.5", " 12:30:00 AM": " 00:30:00", " 11:30pm": " 23:30:00"}[clock]
        for order in {o for _, o, _ in CALENDAR if o}:
            mine = texts.where(F.col("i").isin([i for i, x in enumerate(CALENDAR) if x[1] == order]))
            got = {r.i: r.v for r in mine.select("i", textkinds.as_kind(F.col("t"), kind, order).cast("string").alias("v")).collect()}
            assert got == {i: x[2] + shown for i, x in enumerate(CALENDAR) if x[1] == order}


def test_times_of_day_are_shown_alike(spark):
    df = spark.createDataFrame([("9:05",), ("19:05",), ("9:05:07.25",), (" ",), ("25:00",), (None,)], "t string")
    assert [r.v for r in df.select(textkinds.as_kind(F.col("t"), "TIME").alias("v")).collect()] == ["09:05:00", "19:05:00", "09:05:07.25", None, None, None]
