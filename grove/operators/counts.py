"""Counts and sums over whole tables: frames of one row, or one row a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.columns import is_root
from grove.operators.marks import mark_num_children, with_parent
from grove.operators.pedigree import has_one_parent, root
from grove.plans.folds import keys


def _aggregated(df: DataFrame, **values: Column) -> DataFrame:
    k = keys(df)
    named = [c.alias(n) for n, c in values.items()]
    return df.groupBy(*k).agg(*named) if k else df.agg(*named)


def count_leaf_nodes(df: DataFrame) -> DataFrame:
    return _aggregated(mark_num_children(df, mark_as="_n"), count=F.count_if(F.col("_n") == 0))


def count_inner_nodes(df: DataFrame) -> DataFrame:
    return _aggregated(mark_num_children(df, mark_as="_n"), count=F.count_if(F.col("_n") > 0))


def count_root_nodes(df: DataFrame) -> DataFrame:
    return _aggregated(df, count=F.count_if(root(df)))


def _asexual(df: DataFrame) -> DataFrame:
    """With ancestor_id; ValueError for rows with several parents."""
    from grove.operators.representation import try_add_ancestor_id_col

    out = try_add_ancestor_id_col(df)
    if not has_one_parent(out):
        raise ValueError("only for tables without rows of several parents")
    return out


def count_polytomies(df: DataFrame, *, count_root_self: bool = False) -> DataFrame:
    """Nodes with more than two children; ``count_root_self`` takes a root for a child of itself."""
    df = _asexual(df)
    n = F.col("_n") + (F.when(is_root(), 1).otherwise(0) if count_root_self else F.lit(0))
    return _aggregated(mark_num_children(df, mark_as="_n"), count=F.count_if(n > 2))


def count_unifurcations(df: DataFrame) -> DataFrame:
    return _aggregated(mark_num_children(_asexual(df), mark_as="_n"), count=F.count_if(F.col("_n") == 1))


def count_unifurcating_roots(df: DataFrame) -> DataFrame:
    return _aggregated(mark_num_children(df, mark_as="_n"), count=F.count_if((F.col("_n") == 1) & is_root()))


def count_children_of(df: DataFrame, parent: int) -> DataFrame:
    """ValueError where no node has that id."""
    found = df.filter((F.col("id") == parent) | (F.col("ancestor_id") == parent)).agg(
        F.count_if(F.col("id") == parent).alias("there"), F.count_if((F.col("ancestor_id") == parent) & ~is_root()).alias("count")
    )
    if not found.first().there:
        raise ValueError(f"no node {parent}")
    return found.select("count")


def calc_polytomic_index(df: DataFrame) -> DataFrame:
    """max(2 leaves - roots, 0) - (nodes - unifurcations): what a bifurcating tree has more."""
    counts = _aggregated(
        mark_num_children(df, mark_as="_n"),
        leaves=F.count_if(F.col("_n") == 0),
        roots=F.count_if(is_root()),
        nodes=F.count(F.lit(1)),
        single=F.count_if(F.col("_n") == 1),
    )
    full = F.greatest(2 * F.col("leaves") - F.col("roots"), F.lit(0))
    return counts.select(*keys(df), (full - (F.col("nodes") - F.col("single"))).alias("polytomic_index"))


def sum_origin_time_deltas(df: DataFrame) -> DataFrame:
    if "origin_time_delta" in df.columns:
        return _aggregated(df, sum=F.sum("origin_time_delta"))
    return _aggregated(with_parent(df, _above="origin_time"), sum=F.sum(F.col("origin_time") - F.col("_above")))
