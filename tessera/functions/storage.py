"""Intermediate tables that outlive an executor."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application that names none itself.
_local: dict[str, str] = {}
#: Spark's setting for removing a query's shuffle files when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The list that the tables of the work in hand are noted in, if anybody asked for it.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and its shuffle files go once it is written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    note_table(path)
    return spark.read.schema(df.schema).parquet(path)


#: For each session with intermediate writes under way: how many, and the user's setting.
_writing: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Turns the cleanup on while any thread writes with this session, and back when the last has written."""
    key = spark._jsparkSession.hashCode()  # the same for every Python object of a session
    with _lock:
        if key not in _writing:
            _writing[key] = [0, spark.conf.get(_CLEANUP, "false")]
            spark.conf.set(_CLEANUP, "true")
        _writing[key][0] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[key][0] -= 1
            if not _writing[key][0]:
                spark.conf.set(_CLEANUP, _writing.pop(key)[1])


def note_table(path: str) -> None:
    """Let the surrounding ``noted_tables``, if any, know of a table."""
    if (paths := _noted.get()) is not None:
        paths.append(path)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """Collects the paths of the intermediate tables that the code within writes, and of no others."""
    paths: list[str] = []
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables written within; results must be stored or shown by then."""
    with noted_tables() as paths:
        try:
            yield
        finally:
            delete_tables(spark, paths)
