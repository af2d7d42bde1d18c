"""Where intermediate tables go, and who deletes them."""

import os
from urllib.parse import urlparse

from tessera.functions import storage
from tessera.operators.rowid import assign_row_id


class _Unset:
    """A session whose configuration lacks ``spark.checkpoint.dir``."""

    def __init__(self, spark, master="local[4]"):
        self.conf = self
        self.sparkContext = type("context", (), {"master": master, "applicationId": spark.sparkContext.applicationId})

    def get(self, key, default=None):
        return default


def test_folder_without_setting(spark):
    folder = storage.shared_folder(_Unset(spark))
    assert folder == storage.shared_folder(_Unset(spark)) and os.path.isdir(urlparse(folder).path)
    try:
        storage.shared_folder(_Unset(spark, "spark://host:7077"))
    except ValueError as said:
        assert "spark.checkpoint.dir" in str(said)
    else:
        raise AssertionError("a cluster needs a shared folder")


def test_only_own_tables_are_deleted(spark):
    other = storage.durable(spark.range(3), "other")
    with storage.noted_tables() as paths:
        mine = storage.durable(spark.range(4), "mine")
        with storage.noted_tables() as inner:
            storage.durable(spark.range(5), "inner")
        assert len(paths) == 1 and len(inner) == 1 and mine.count() == 4
    held = [urlparse(p).path for p in paths]
    storage.delete_tables(spark, paths)
    assert not any(map(os.path.exists, held)) and other.count() == 3 and not paths


def test_temporary_tables(spark):
    with storage.temporary_tables(spark):
        path = storage.fresh_path(spark, "x")
        assign_row_id(spark.range(10)).write.parquet(path)
        kept = storage._noted.get()
        held = [urlparse(p).path for p in kept]
    assert held and not any(map(os.path.exists, held)) and spark.read.parquet(path).count() == 10


def test_a_durable_table_leaves_no_setting_changed_and_reads_after_its_shuffles_are_gone(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    grouped = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    table = storage.durable(grouped, "grouped")
    assert spark.conf.get(key) == was
    assert sorted(table.collect()) == sorted(grouped.collect())
    assert sorted(storage.durable(grouped, "again").collect()) == sorted(grouped.collect())


def test_writes_of_many_threads_leave_the_session_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from tessera.functions import storage

    was = spark.conf.get(storage._CLEANUP, "false")
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda i: storage.durable(spark.range(i + 1).toDF("x"), "many").count(), range(12)))
    assert counts == list(range(1, 13)) and spark.conf.get(storage._CLEANUP) == was and storage._writing == {}
