"""Looking up one row of a table by a key that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key that may meet in a task.
HEAVY = 20_000


def look_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` left-joined with ``table``, which has each key once.

    A key of more than HEAVY rows, a parent of very many children, say, does
    not gather them: its row of ``table`` goes to where they are. Such keys are
    found by a count; there is one at most for every HEAVY rows.
    """
    counts = rows.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.filter(F.col("_n") > HEAVY).select(*on).collect()
    if not heavy:
        return rows.join(table, on, "left")
    keys = F.broadcast(rows.sparkSession.createDataFrame(heavy, T.StructType([rows.schema[c] for c in on])))  # few, as above
    many = rows.join(keys, on, "left_semi").join(F.broadcast(table.join(keys, on, "left_semi")), on, "left")
    return many.unionByName(rows.join(keys, on, "left_anti").join(table, on, "left"))
