"""Intermediate tables that outlive an executor, and batches of bounded size."""

from pyspark.sql import SparkSession

from ..functions.storage import delete_tables, durable, fresh_path, note_table, noted_tables, shared_folder

__all__ = ["delete_tables", "durable", "fresh_path", "note_table", "noted_tables", "shared_folder", "text_batches"]

_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def text_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Send texts to Python about ``size`` bytes at a time; a session with its own setting keeps it.

    Spark's default of 64 MB is held several times over, in buffers on both
    sides of each task.  A batch ends with the row that reaches the bound, so
    only a single text can be longer.
    """
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(size))
