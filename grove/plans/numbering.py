"""Places of rows in an order, without a task that holds a whole table.

A table with ``tree_id`` is numbered within trees, by a window. Without one it
is dealt by range of the order into a written table; each part is numbered by
a window of its own, and one row a part (counts, sums, last values) reaches
the driver, which gives each part what comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.plans.folds import keys
from grove.plans.scratch import cut


def running(df: DataFrame, by: list[Column | str], folds: dict[str, tuple[str, str]]) -> DataFrame:
    """Add, for each name, the (min or max, column) over a row and all before it in the order of ``by``, within a tree."""
    k = keys(df)
    order = Window.partitionBy(*(k or ["_part"])).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    how = {"min": (F.min, F.least, min), "max": (F.max, F.greatest, max)}
    columns = {name: how[fold][0](column).over(order) for name, (fold, column) in folds.items()}
    if k:
        return df.withColumns(columns)
    parts, _ = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    each = parts.groupBy("_part").agg(*(how[fold][0](column).alias(name) for name, (fold, column) in folds.items())).orderBy("_part").collect()
    offsets, passed = [], {name: None for name in folds}
    for row in each:
        offsets.append((row["_part"], *passed.values()))
        for name, (fold, _) in folds.items():
            passed[name] = how[fold][2](x for x in (passed[name], row[name]) if x is not None)
    kinds = ", ".join(f"_before_{name} {df.schema[column].dataType.simpleString()}" for name, (_, column) in folds.items())
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_part int, {kinds}"))  # a row a part
    out = parts.withColumns(columns).join(known, "_part")
    merged = {name: how[fold][1](name, f"_before_{name}") for name, (fold, _) in folds.items()}
    return out.withColumns(merged).drop("_part", *(f"_before_{name}" for name in folds))


def numbered(df: DataFrame, by: list[Column | str], name: str, *, sum_of: str | None = None, lag_of: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of ``by``, within a tree.

    With ``sum_of`` it is the sum of that column over the rows before, with
    ``lag_of`` the value of that column in the row before, null in the first;
    for that one ``by`` is one column, rising.
    """
    k = keys(df)
    order = Window.partitionBy(*(k or ["_part"])).orderBy(*by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    if lag_of:
        place = F.lag(lag_of).over(order)
    elif sum_of:
        place = F.coalesce(F.sum(sum_of).over(before), F.lit(0)).cast("long")
    else:
        place = (F.row_number().over(order) - 1).cast("long")
    if k:
        return df.withColumn(name, place)
    parts, _ = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    if lag_of:
        last = parts.groupBy("_part").agg(F.max_by(F.struct(lag_of), by[0])[lag_of].alias("_v"), F.min(by[0]).alias("_first"))
        rows = last.orderBy("_part").collect()
        offsets = [(r["_part"], r["_first"], x["_v"]) for x, r in zip(rows, rows[1:])]
        kinds = f"_part int, _first {last.schema['_first'].dataType.simpleString()}, _offset {df.schema[lag_of].dataType.simpleString()}"
        known = F.broadcast(df.sparkSession.createDataFrame(offsets, kinds))  # a row a part
        first = F.col(by[0]) == F.col("_first")
        out = parts.withColumn(name, place).join(known, "_part", "left")
        return out.withColumn(name, F.when(first, F.col("_offset")).otherwise(F.col(name))).drop("_part", "_first", "_offset")
    each = parts.groupBy("_part").agg((F.coalesce(F.sum(sum_of), F.lit(0)) if sum_of else F.count(F.lit(1))).cast("long").alias("_v"))
    offsets, passed = [], 0
    for row in each.orderBy("_part").collect():
        offsets.append((row["_part"], passed))
        passed += row["_v"]
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _offset long"))  # a row a part
    return parts.withColumn(name, place).join(known, "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")


def before_in_group(df: DataFrame, group: list[str], by: list[Column | str], name: str, *, sum_of: str) -> DataFrame:
    """Add ``name``: the sum of a column over the rows of the same group that come before in the order of ``by``.

    Rows are dealt by range of group and order, so that a group may lie in
    several parts: what its rows in earlier parts sum up to, one number a
    part, is added by way of the driver. ``group`` has no nulls.
    """
    parts, _ = cut(df.repartitionByRange(*group, *by).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part", F.struct(*group).alias("_g")).agg(F.coalesce(F.sum(sum_of), F.lit(0)).cast("long").alias("_v"))
    ends = sums.groupBy("_part").agg(F.min("_g").alias("first"), F.max("_g").alias("last"), F.max_by("_v", "_g").alias("_v")).orderBy("_part")
    offsets, open_group, passed = [], None, 0
    for part in ends.collect():
        begun = passed if part["first"] == open_group else 0
        offsets.append((part["_part"], *part["first"], begun))
        open_group, passed = part["last"], part["_v"] + (begun if part["first"] == part["last"] else 0)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in group)
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_part int, {kinds}, _offset long"))  # a row a part
    own = F.coalesce(F.sum(sum_of).over(before), F.lit(0)).cast("long")
    return parts.withColumn(name, own).join(known, ["_part", *group], "left").withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_part", "_offset")
