"""Tables as an immutable base and the rows that changed since, merged when read.

A layer after the base holds whole changed or new rows and the ids of deleted
ones (``__gone``).  Reading takes the latest layer's word for each id: ids met in
any layer leave the base by an anti join, and those not gone come back in their
last form.  The number of changed rows is known, so their ids are broadcast while
they are few and the base is not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ROW_ID, col

GONE = "__gone"
#: Ids (a hash table of longs, about 50 bytes each) that are broadcast; more are joined by shuffle.
MOST_BROADCAST_IDS = 500_000
#: Layers over a base, and their share of its rows, beyond which a new base is written.
MOST_LAYERS, MOST_CHANGED = 16, 0.25


@dataclass(frozen=True)
class Layer:
    path: str
    rows: int


def layer_of(changed: DataFrame | None, deleted: DataFrame | None, schema: T.StructType, spark: SparkSession) -> DataFrame:
    """Changed rows (of ``schema``) and deleted ids (the first column of ``deleted``) as one table to store."""
    id_type = schema[ROW_ID].dataType
    parts = []
    if changed is not None:
        parts.append(changed.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(False).alias(GONE)))
    if deleted is not None:
        ids = deleted.select(deleted[0].cast(id_type).alias(ROW_ID)).distinct()
        parts.append(ids.select(*[F.col(ROW_ID) if f.name == ROW_ID else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(True).alias(GONE)))
    if not parts:
        parts = [spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())]))]
    return reduce(DataFrame.unionByName, parts)


def merged(spark: SparkSession, base: Layer, layers: list[Layer], ids: DataFrame | None = None) -> DataFrame:
    """The table as it is after all ``layers``; only the rows of ``ids`` (first column), if given."""
    whole = spark.read.parquet(base.path)
    if ids is not None:
        whole = whole.join(ids.select(ids[0].alias("__wanted")), F.col(ROW_ID) == F.col("__wanted"), "left_semi")
    if not layers:
        return whole
    names = whole.columns
    stored = [spark.read.parquet(x.path).withColumn("__layer", F.lit(i)) for i, x in enumerate(layers)]
    if len(stored) == 1:
        last = stored[0].drop("__layer")
    else:
        row = F.struct(*map(col, [*names, GONE]))
        every = reduce(DataFrame.unionByName, stored)
        last = every.groupBy(col(ROW_ID).alias("__key")).agg(F.max_by(row, "__layer").alias("r")).select("r.*")
    met = last.select(col(ROW_ID).alias("__met"))
    if sum(x.rows for x in layers) <= MOST_BROADCAST_IDS:
        met = F.broadcast(met)
    kept = whole.join(met, F.col(ROW_ID) == F.col("__met"), "left_anti")
    new = last.where(~F.col(GONE)).select(*map(col, names))
    if ids is not None:
        new = new.join(ids.select(ids[0].alias("__wanted")), F.col(ROW_ID) == F.col("__wanted"), "left_semi")
    return kept.unionAll(new)
