"""Row numbers 1..n in a given order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ROW_ID
from ..functions.storage import durable


def assign_row_id(df: DataFrame, *order: Column, name: str = ROW_ID) -> DataFrame:
    """``df`` with a first column ``name`` numbering its rows from 1 in ``order`` (as they come, if none).

    The sorted rows are written once with their partition and place in it, so
    that the counts and the numbers are of the same rows even if an executor is
    lost; a count per partition is all that the driver sees.
    """
    ranked = df.drop(name)
    if order:
        ranked = ranked.orderBy(*order)
    place = F.monotonically_increasing_id()
    kept = durable(ranked.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "rows")
    counts = kept.groupBy("__part").count().collect()
    total, starts = 0, []
    for part, n in sorted(tuple(r) for r in counts):
        starts.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(starts, "__part long, __base long")
    # One row per partition of the sort, which the driver has just counted.
    numbered = kept.join(F.broadcast(base), "__part")
    return numbered.select((F.col("__base") + F.col("__place") + 1).alias(name), *[F.col("`" + c.replace("`", "``") + "`") for c in ranked.columns])
