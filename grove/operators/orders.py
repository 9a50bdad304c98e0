"""Traversals: frames of (ord, id), with tree_id where there is one.

Orders come from the walk numbers of ``grove.plans.folds.euler`` or from depth
and position, so no traversal runs one node after another. ``ord`` counts
within a tree from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions.columns import is_root
from grove.operators.checks import position
from grove.operators.marks import mark_leaves, mark_node_depth, require_bifurcating, siblings
from grove.plans.folds import down, euler, keys, up
from grove.plans.numbering import numbered


def _ordered(df: DataFrame, *by: Column | str) -> DataFrame:
    k = keys(df)
    return numbered(df, list(by), "ord").select(*k, "ord", "id")


def _bare(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*dict.fromkeys([*keys(df), "id", "ancestor_id", position(df), *more]))


def unfurl_traversal_preorder(df: DataFrame) -> DataFrame:
    """Depth first, children by id; the trees of a forest by the ids of their roots."""
    return euler(_bare(df)).select(*keys(df), F.col("pre").alias("ord"), "id")


def unfurl_traversal_postorder_contiguous(df: DataFrame, child_order: str = "asc") -> DataFrame:
    """Children before parents, each clade in one piece."""
    if child_order not in ("asc", "desc"):
        raise ValueError(f"child_order is asc or desc, not {child_order}")
    return euler(_bare(df), descending=child_order == "desc").select(*keys(df), F.col("post").alias("ord"), "id")


def unfurl_traversal_postorder(df: DataFrame) -> DataFrame:
    """Children before parents, level by level from the deepest."""
    pos = position(df)
    return _ordered(mark_node_depth(_bare(df), mark_as="_d"), F.desc("_d"), F.desc("ancestor_id"), F.desc(pos))


def unfurl_traversal_levelorder(df: DataFrame) -> DataFrame:
    return _ordered(mark_node_depth(_bare(df), mark_as="_d"), "_d", position(df))


def unfurl_traversal_topological(df: DataFrame) -> DataFrame:
    """Parents before children; the rows' own order where it already is one."""
    from grove.operators.checks import is_topologically_sorted

    if is_topologically_sorted(df).first().result:
        return _ordered(_bare(df), position(df))
    return unfurl_traversal_levelorder(df)


def _between(df: DataFrame, first: Column) -> DataFrame:
    """Node between its two children's clades; ``first`` is true for the child that comes first.

    A node stands as many places behind its clade's start as its first child's
    clade is large; a second child's clade starts behind its sister's and the parent.
    """
    require_bifurcating(df)
    w = siblings(df).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = up(df.withColumn("_first", first), {"_size": (F.lit(1), "sum")})
    sister = F.sum("_size").over(w) - F.col("_size")
    moved = sized.withColumn("_step", F.when(is_root() | F.col("_first"), F.lit(0)).otherwise(sister + 1))
    starts = down(moved, {"_start": ("_step", "sum")})
    k = keys(df)
    left = starts.filter(~is_root() & F.col("_first")).select(*k, F.col("ancestor_id").alias("id"), F.col("_size").alias("_before"))
    at = F.col("_start") + F.coalesce("_before", F.lit(0))
    return starts.join(left, [*k, "id"], "left").select(*k, at.alias("ord"), "id")


def _single_root(df: DataFrame) -> None:
    if df.filter(is_root()).groupBy(*keys(df)).count().filter("count > 1").limit(1).count():
        raise ValueError("a tree has several roots")


def unfurl_traversal_inorder(df: DataFrame) -> DataFrame:
    """Left clade, node, right clade; for strictly bifurcating trees of one root."""
    _single_root(df)
    bare = _bare(df)
    return _between(bare, F.lag("id").over(siblings(bare)).isNull())


def unfurl_traversal_semiorder(df: DataFrame) -> DataFrame:
    """Node between its children's clades, that with the smallest leaf id first."""
    _single_root(df)
    bare = mark_leaves(_bare(df), mark_as="_leaf")
    least = up(bare.withColumn("_id", F.when(F.col("_leaf"), F.col("id"))), {"_least": ("_id", "min")}).drop("_leaf", "_id")
    first = F.col("_least") == F.min("_least").over(siblings(least).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _between(least, first)
