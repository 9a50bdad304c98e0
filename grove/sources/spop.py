"""Avida population files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_avida_spop(spark: SparkSession, path: str | None = None, *, text: str | None = None, create_ancestor_list: bool = True) -> DataFrame:
    """Organisms of a population file: columns by its ``#format`` line, ``parents`` as ancestor_list, ``update_born`` as origin_time.

    Fields that a line lacks are NONE. ValueError without a format line or for ids that repeat.
    """
    if text is not None:
        lines = spark.createDataFrame([(x,) for x in text.splitlines()] or [("",)], "value string")
    else:
        lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("#format")).first()
    if head is None:
        raise ValueError("no #format line")
    names = head.value.split()[1:]
    rows = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("v"))
    rows = rows.select(*(F.coalesce(F.get("v", F.lit(i)), F.lit("NONE")).alias(n) for i, n in enumerate(names)))
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    parents = F.when(F.lower("parents") == "(none)", F.lit("[none]")).otherwise(F.concat(F.lit("["), F.col("parents"), F.lit("]")))
    out = rows.withColumns({"id": F.col("id").cast("long"), "ancestor_list": parents, "origin_time": F.try_to_number("update_born", F.lit("S999999999999")).cast("long")})
    if not create_ancestor_list:
        from grove.functions.columns import make_ancestor_id

        out = out.withColumn("ancestor_id", make_ancestor_id(F.col("id"), F.col("ancestor_list"))).drop("ancestor_list")
    return out.drop("parents", "update_born")
