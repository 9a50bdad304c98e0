"""Ids, lists, orders of rows, and pipes."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.columns import ANCESTOR, ID, LIST, convert_root_ancestor_token, make_ancestor_id, make_ancestor_list, parse_ancestor_ids
from grove.operators.checks import is_asexual, position
from grove.operators.marks import mark_node_depth, mark_num_leaves
from grove.operators.pedigree import pedigree_depth
from grove.plans.folds import keys
from grove.plans.numbering import numbered


def make_ancestor_id_col(df: DataFrame) -> DataFrame:
    return df.withColumn(ANCESTOR, make_ancestor_id(F.col(ID), F.col(LIST)).cast(df.schema[ID].dataType))


def make_ancestor_list_col(df: DataFrame, root_ancestor_token: str = "none") -> DataFrame:
    return df.withColumn(LIST, make_ancestor_list(F.col(ID), F.col(ANCESTOR), root_ancestor_token))


def try_add_ancestor_id_col(df: DataFrame) -> DataFrame:
    """With ancestor_id if no row has several ancestors; of the type of id."""
    if ANCESTOR in df.columns:
        return df.withColumn(ANCESTOR, F.col(ANCESTOR).cast(df.schema[ID].dataType))
    return make_ancestor_id_col(df) if is_asexual(df).first().result else df


def try_add_ancestor_list_col(df: DataFrame, root_ancestor_token: str = "none") -> DataFrame:
    return df if LIST in df.columns or ANCESTOR not in df.columns else make_ancestor_list_col(df, root_ancestor_token)


def assign_root_ancestor_token(df: DataFrame, root_ancestor_token: str) -> DataFrame:
    return df.withColumn(LIST, convert_root_ancestor_token(F.col(LIST), root_ancestor_token))


def _renumbered(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """New ids from 0 in the order of ``by``; ancestors follow."""
    k = keys(df)
    new = numbered(df, by, "_new").withColumn("_new", F.col("_new").cast(df.schema[ID].dataType))
    names = new.select(*k, F.col(ID).alias("_old"), F.col("_new").alias("_renamed"))
    if ANCESTOR in df.columns:
        out = new.join(names.withColumnRenamed("_old", ANCESTOR), [*k, ANCESTOR], "left")
        out = out.withColumns({ANCESTOR: F.col("_renamed"), ID: F.col("_new")})
        if LIST in df.columns:
            out = out.withColumn(LIST, make_ancestor_list(F.col(ID), F.col(ANCESTOR)))
        return out.select(df.columns)
    links = new.select(*k, "_new", F.explode(parse_ancestor_ids(F.col(LIST))).alias("_old")).join(names, [*k, "_old"])
    lists = links.groupBy(*k, "_new").agg(F.array_sort(F.collect_list("_renamed")).alias("_a"))  # an organism's few parents
    text = F.concat(F.lit("["), F.concat_ws(",", F.transform("_a", lambda x: x.cast("string"))), F.lit("]"))
    out = new.join(lists, [*k, "_new"], "left").withColumn(LIST, F.when(F.col("_a").isNull(), "[none]").otherwise(text))
    return out.withColumn(ID, F.col("_new")).select(df.columns)


def assign_contiguous_ids(df: DataFrame) -> DataFrame:
    """id becomes the row number (by ``pos``, or by the old id)."""
    return _renumbered(df, [position(df)])


def to_working_format(df: DataFrame) -> DataFrame:
    """With ancestor_id, parents before children, ids from 0 in that order."""
    out = try_add_ancestor_id_col(df)
    deep = mark_node_depth(out, mark_as="_d")
    return _renumbered(deep, ["_d", position(df)]).drop("_d")


def topological_sort(df: DataFrame) -> DataFrame:
    """Parents before children: ``pos`` is the new order, also of organisms with several parents."""
    out = try_add_ancestor_id_col(df)
    deep = mark_node_depth(out, mark_as="_d") if ANCESTOR in out.columns else pedigree_depth(out, mark_as="_d")
    return numbered(deep, ["_d", position(df)], "_pos").drop("_d", "pos").withColumnRenamed("_pos", "pos").select(*(c for c in df.columns if c != "pos"), "pos")


def _placed(df: DataFrame, *by: Column | str) -> DataFrame:
    """``pos`` by an order, within a tree."""
    return numbered(df, list(by), "_pos").drop("pos").withColumnRenamed("_pos", "pos")


def chronological_sort(df: DataFrame, how: str = "origin_time") -> DataFrame:
    return _placed(df, how, position(df))


def sort_children(df: DataFrame, criterion: str | Column, *, reverse: bool = False) -> DataFrame:
    """Rows by depth, parent and criterion; ``pos`` is the new order, ties by the old one."""
    value = F.col(criterion) if isinstance(criterion, str) else criterion
    deep = mark_node_depth(df.withColumn("_c", value), mark_as="_d")
    return _placed(deep, "_d", "ancestor_id", F.desc("_c") if reverse else F.col("_c"), position(df)).drop("_d", "_c")


def ladderize(df: DataFrame, *, reverse: bool = False) -> DataFrame:
    counted = mark_num_leaves(df, mark_as="num_leaves")
    return sort_children(counted, "num_leaves", reverse=reverse)


def pipe_unary_ops(df: DataFrame, *unary_ops: Callable[[DataFrame], DataFrame] | str) -> DataFrame:
    """Functions one after another; a text names one of the registry, no text is evaluated."""

    def step(frame: DataFrame, op: Callable[[DataFrame], DataFrame] | str) -> DataFrame:
        if isinstance(op, str):
            from grove.registry import OPERATORS

            op = OPERATORS[op]
        return frame.transform(op)

    return functools.reduce(step, unary_ops, df)
