"""Columns added to the nodes of trees.

Every function takes a table with ``id`` and ``ancestor_id`` (a root is its
own ancestor), and perhaps ``tree_id``, and returns it with one more column,
named by ``mark_as``. One-hop marks are joins, windows and expressions;
lineage and clade marks are folds (``grove.plans.folds``), which choose their
engine by the size of the largest tree. Helper columns never stay. Empty
tables give empty tables.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions.columns import ieee_div, is_root
from grove.operators.pedigree import edges, has_one_parent, root, root_ids
from grove.plans.folds import down, keys, up
from grove.plans.lookup import look_up
from grove.plans.numbering import numbered

# ---------------------------------------------------------------- one hop


def with_children(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Join each node with aggregates over its children; null where there are none."""
    k = keys(df)
    stats = edges(df).groupBy(*k, F.col("ancestor_id").alias("id")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return df.join(stats, [*k, "id"], "left").select(*df.columns, *aggregates)


def with_parent(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Join each node with columns of its parent; a root with its own."""
    k = keys(df)
    above = df.select(*k, F.col("id").alias("ancestor_id"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))
    return look_up(df, above, [*k, "ancestor_id"]).select(*df.columns, *columns)


def siblings(df: DataFrame):
    """Window over the children of one parent, by id; roots are apart."""
    return Window.partitionBy(*keys(df), "ancestor_id", is_root()).orderBy("id")


def _kept(df: DataFrame, out: DataFrame, mark_as: str) -> DataFrame:
    return out.select(*(c for c in df.columns if c != mark_as), mark_as)


def mark_roots(df: DataFrame, *, mark_as: str = "is_root") -> DataFrame:
    return df.withColumn(mark_as, root(df))


def mark_num_children(df: DataFrame, *, mark_as: str = "num_children") -> DataFrame:
    base = df.drop(mark_as)
    return with_children(base, **{mark_as: F.count(F.lit(1))}).withColumn(mark_as, F.coalesce(mark_as, F.lit(0)).cast("long"))


def mark_leaves(df: DataFrame, *, mark_as: str = "is_leaf") -> DataFrame:
    base = df.drop(mark_as)
    return with_children(base, **{mark_as: F.count(F.lit(1))}).withColumn(mark_as, F.col(mark_as).isNull())


def mark_oldest_root(df: DataFrame, *, mark_as: str = "is_oldest_root") -> DataFrame:
    """The root with the lowest (origin_time, id), or the lowest id without origin_time."""
    k = keys(df)
    first = F.struct(*(["origin_time"] if "origin_time" in df.columns else []), "id")
    roots = df.filter(root(df)).groupBy(*k).agg(F.min(first).getField("id").alias("_oldest"))
    joined = df.join(roots, k) if k else df.crossJoin(F.broadcast(roots))  # without trees one row
    return _kept(df, joined.withColumn(mark_as, F.col("id") == F.col("_oldest")), mark_as)


def mark_ancestor_origin_time(df: DataFrame, *, mark_as: str = "ancestor_origin_time") -> DataFrame:
    return with_parent(df.drop(mark_as), **{mark_as: "origin_time"})


def mark_origin_time_delta(df: DataFrame, *, mark_as: str = "origin_time_delta") -> DataFrame:
    out = with_parent(df.drop(mark_as), _above="origin_time")
    return _kept(df, out.withColumn(mark_as, F.col("origin_time") - F.col("_above")), mark_as)


def mark_first_child_id(df: DataFrame, *, mark_as: str = "first_child_id") -> DataFrame:
    return with_children(df.drop(mark_as), **{mark_as: F.min("id")}).withColumn(mark_as, F.coalesce(mark_as, "id"))


def mark_next_sibling_id(df: DataFrame, *, mark_as: str = "next_sibling_id") -> DataFrame:
    return df.withColumn(mark_as, F.when(is_root(), F.col("id")).otherwise(F.coalesce(F.lead("id").over(siblings(df)), "id")))


def mark_prev_sibling_id(df: DataFrame, *, mark_as: str = "prev_sibling_id") -> DataFrame:
    return df.withColumn(mark_as, F.when(is_root(), F.col("id")).otherwise(F.coalesce(F.lag("id").over(siblings(df)), "id")))


def require_bifurcating(df: DataFrame) -> None:
    """ValueError unless every node has no child or two."""
    k = keys(df)
    if df.filter(~is_root()).groupBy(*k, "ancestor_id").count().filter("count <> 2").limit(1).count():
        raise ValueError("the tree is not strictly bifurcating")


def _bifurcating(function):
    @functools.wraps(function)
    def run(df: DataFrame, *args, assume_valid: bool = False, **kwargs) -> DataFrame:
        if not assume_valid:
            require_bifurcating(df)
        return function(df, *args, **kwargs)

    return run


@_bifurcating
def mark_left_child(df: DataFrame, *, mark_as: str = "left_child_id") -> DataFrame:
    return mark_first_child_id(df, mark_as=mark_as)


@_bifurcating
def mark_right_child(df: DataFrame, *, mark_as: str = "right_child_id") -> DataFrame:
    return with_children(df.drop(mark_as), **{mark_as: F.max("id")}).withColumn(mark_as, F.coalesce(mark_as, "id"))


@_bifurcating
def mark_is_left_child(df: DataFrame, *, mark_as: str = "is_left_child") -> DataFrame:
    return df.withColumn(mark_as, ~is_root() & F.lag("id").over(siblings(df)).isNull())


@_bifurcating
def mark_is_right_child(df: DataFrame, *, mark_as: str = "is_right_child") -> DataFrame:
    return df.withColumn(mark_as, ~is_root() & F.lag("id").over(siblings(df)).isNotNull())


@_bifurcating
def mark_sister(df: DataFrame, *, mark_as: str = "sister_id") -> DataFrame:
    w = siblings(df)
    return df.withColumn(mark_as, F.when(is_root(), F.col("id")).otherwise(F.coalesce(F.lead("id").over(w), F.lag("id").over(w), "id")))


def mark_csr_offsets(df: DataFrame, *, mark_as: str = "csr_offsets") -> DataFrame:
    """Exclusive prefix sum of child counts in id order, within a tree."""
    return _kept(df, numbered(mark_num_children(df.drop(mark_as), mark_as="_n"), ["id"], mark_as, sum_of="_n"), mark_as)


def mark_csr_children(df: DataFrame, *, mark_as: str = "csr_children") -> DataFrame:
    """The flat array of children (by parent, then id) along the rows in id order; -1 beyond its end."""
    k = keys(df)
    flat = numbered(df.filter(~is_root()).select(*k, "id", "ancestor_id"), ["ancestor_id", "id"], "_at").select(*k, "_at", F.col("id").alias(mark_as))
    placed = numbered(df.drop(mark_as), ["id"], "_at")
    return _kept(df, placed.join(flat, [*k, "_at"], "left").withColumn(mark_as, F.coalesce(mark_as, F.lit(-1))), mark_as)


# ---------------------------------------------------------------- lineages


def _step() -> Column:
    return F.when(is_root(), F.lit(0)).otherwise(F.lit(1))


def mark_node_depth(df: DataFrame, *, mark_as: str = "node_depth") -> DataFrame:
    return down(df, {mark_as: (_step(), "sum")})


def mark_root_id(df: DataFrame, selector: str = "min", *, mark_as: str = "root_id") -> DataFrame:
    """The root above each row; of several, for rows with several parents, the one that ``selector`` (min or max) takes."""
    if has_one_parent(df):
        return down(df, {mark_as: ("id", "first")})
    base = df.drop(mark_as)
    return base.join(root_ids(base, selector).withColumnRenamed("value", mark_as), [*keys(df), "id"])


def _cumulative(df: DataFrame, values: str | Column, mark_as: str, fold: str, reverse: bool, skipna: bool) -> DataFrame:
    x = (F.col(values) if isinstance(values, str) else values).cast("double")
    bare = F.when(F.isnan(x), F.lit(None)).otherwise(x)  # the fold's identity takes a null's place
    run = up if reverse else down
    if skipna:
        return run(df, {mark_as: (bare, fold)})
    # A missing value spreads: as a flag, since maximum and minimum of the engines differ on NaN.
    out = run(df, {mark_as: (bare, fold), "_missing": (F.when(x.isNull() | F.isnan(x), 1).otherwise(0), "max")})
    return _kept(df, out.withColumn(mark_as, F.when(F.col("_missing") > 0, float("nan")).otherwise(F.col(mark_as))), mark_as)


def mark_lineage_cumsum(df: DataFrame, values: str | Column, *, mark_as: str = "lineage_cumsum", reverse: bool = False, skipna: bool = True) -> DataFrame:
    """Inclusive sum from the root to a node, or over its clade with ``reverse``."""
    return _cumulative(df, values, mark_as, "sum", reverse, skipna)


def mark_lineage_cumprod(df: DataFrame, values: str | Column, *, mark_as: str = "lineage_cumprod", reverse: bool = False, skipna: bool = True) -> DataFrame:
    return _cumulative(df, values, mark_as, "prod", reverse, skipna)


def mark_lineage_cummax(df: DataFrame, values: str | Column, *, mark_as: str = "lineage_cummax", reverse: bool = False, skipna: bool = True) -> DataFrame:
    return _cumulative(df, values, mark_as, "max", reverse, skipna)


def mark_lineage_cummin(df: DataFrame, values: str | Column, *, mark_as: str = "lineage_cummin", reverse: bool = False, skipna: bool = True) -> DataFrame:
    return _cumulative(df, values, mark_as, "min", reverse, skipna)


def mask_descendants(df: DataFrame, *, ancestor_mask: str | Column, mark_as: str = "mask_descendants") -> DataFrame:
    """True for marked nodes and all below them."""
    mask = F.col(ancestor_mask) if isinstance(ancestor_mask, str) else ancestor_mask
    out = down(df, {mark_as: (F.when(mask, 1).otherwise(0), "max")})
    return out.withColumn(mark_as, F.col(mark_as) > 0)


@_bifurcating
def mark_num_preceding_leaves(df: DataFrame, *, mark_as: str = "num_preceding_leaves") -> DataFrame:
    """Leaves before a node in inorder."""
    leaves = mark_num_leaves(df, mark_as="_leaves")
    w = siblings(df)
    step = F.when(is_root() | F.lag("id").over(w).isNull(), F.lit(0)).otherwise(F.lag("_leaves").over(w))
    return down(leaves.withColumn("_before", step), {mark_as: ("_before", "sum")}).drop("_leaves", "_before")


def ancestors_at(df: DataFrame, steps: int, mark_as: str) -> DataFrame:
    """The ancestor ``steps`` up, no higher than the root; log2(steps) joins."""
    k = keys(df)
    hop = df.select(*k, "id", F.col("ancestor_id").alias("up"))
    at = df.select(*k, "id", F.col("id").alias("now"))
    while steps:
        if steps & 1:
            at = at.join(hop.select(*k, F.col("id").alias("now"), "up"), [*k, "now"]).select(*k, "id", F.col("up").alias("now"))
        steps >>= 1
        if steps:
            hop = hop.join(hop.select(*k, F.col("id").alias("up"), F.col("up").alias("further")), [*k, "up"]).select(*k, "id", F.col("further").alias("up"))
    return df.drop(mark_as).join(at.withColumnRenamed("now", mark_as), [*k, "id"]).select(*(c for c in df.columns if c != mark_as), mark_as)


def calc_clade_lookback_n(df: DataFrame, lookback_n: int, *, mark_as: str = "lookback_id") -> DataFrame:
    return ancestors_at(df, lookback_n, mark_as)


def unfurl_lineage(df: DataFrame, leaf_id: int) -> DataFrame:
    """(ord, id) from a node up to its root. The path is what has it in its clade, a chain, of which that many hang on each."""
    k = keys(df)
    marked = up(df.select(*k, "id", "ancestor_id"), {"_over": (F.when(F.col("id") == leaf_id, 1).otherwise(0), "max")})
    path = marked.filter("_over > 0").select(*k, "id", "ancestor_id")
    return up(path, {"ord": (F.lit(1), "sum")}).select(*k, (F.col("ord") - 1).alias("ord"), "id")


# ---------------------------------------------------------------- clades


def mark_num_descendants(df: DataFrame, *, mark_as: str = "num_descendants") -> DataFrame:
    return up(df, {mark_as: (F.lit(1), "sum")}).withColumn(mark_as, F.col(mark_as) - 1)


def mark_num_leaves(df: DataFrame, *, mark_as: str = "num_leaves") -> DataFrame:
    return up(mark_leaves(df, mark_as="_counts"), {mark_as: ("_counts", "sum")}).drop("_counts")


def mark_num_leaves_sibling(df: DataFrame, *, mark_as: str = "num_leaves_sibling") -> DataFrame:
    """Leaves of the parent's clade outside the own one."""
    out = with_parent(mark_num_leaves(df.drop(mark_as), mark_as="_own"), _all="_own")
    return _kept(df, out.withColumn(mark_as, F.col("_all") - F.col("_own")), mark_as)


def mark_max_descendant_origin_time(df: DataFrame, *, mark_as: str = "max_descendant_origin_time") -> DataFrame:
    """The latest origin_time of the clade, the node itself included."""
    return up(df, {mark_as: (F.col("origin_time").cast("double"), "max")})


def mark_clade_duration(df: DataFrame, *, mark_as: str = "clade_duration") -> DataFrame:
    out = mark_max_descendant_origin_time(df, mark_as=mark_as)
    return out.withColumn(mark_as, F.col(mark_as) - F.col("origin_time"))


def mark_clade_subtended_duration(df: DataFrame, *, mark_as: str = "clade_subtended_duration") -> DataFrame:
    """From the parent's origin_time (0 for a root) to the latest one of the clade."""
    out = with_parent(mark_max_descendant_origin_time(df.drop(mark_as), mark_as="_last"), _above="origin_time")
    since = F.when(is_root(), F.lit(0.0)).otherwise(F.col("_above").cast("double"))
    return _kept(df, out.withColumn(mark_as, F.col("_last") - since), mark_as)


def mark_clade_faithpd(df: DataFrame, *, mark_as: str = "clade_faithpd") -> DataFrame:
    """Sum of branch lengths of proper descendants."""
    base = df if "origin_time_delta" in df.columns else mark_origin_time_delta(df, mark_as="_delta")
    delta = "origin_time_delta" if "origin_time_delta" in df.columns else "_delta"
    # A branch belongs to its parent's proper descendants: children's sums, folded.
    below = with_children(base.drop(mark_as), _below=F.sum(F.col(delta).cast("double")))
    return _kept(df, up(below, {mark_as: ("_below", "sum")}), mark_as)


def mark_sackin_index(df: DataFrame, *, mark_as: str = "sackin_index") -> DataFrame:
    """Sum over proper descendants of their leaf counts, which is the sum of the leaves' depths in the clade."""
    out = up(mark_num_leaves(df.drop(mark_as), mark_as="_leaves"), {mark_as: ("_leaves", "sum")})
    return _kept(df, out.withColumn(mark_as, F.col(mark_as) - F.col("_leaves")), mark_as)


@_bifurcating
def mark_colless_index(df: DataFrame, *, mark_as: str = "colless_index") -> DataFrame:
    leaves = mark_num_leaves(df.drop(mark_as), mark_as="_leaves")
    local = with_children(leaves, _local=F.max("_leaves") - F.min("_leaves"))
    return _kept(df, up(local, {mark_as: ("_local", "sum")}), mark_as)


@_bifurcating
def mark_colless_index_corrected(df: DataFrame, *, mark_as: str = "colless_index_corrected") -> DataFrame:
    both = mark_num_leaves(mark_colless_index(df.drop(mark_as), mark_as="_c", assume_valid=True), mark_as="_n")
    n = F.col("_n").cast("double")
    return _kept(df, both.withColumn(mark_as, F.when(n > 2, F.try_divide(2.0 * F.col("_c"), (n - 1) * (n - 2))).otherwise(0.0)), mark_as)


def _colless_like(df: DataFrame, mark_as: str, spread) -> DataFrame:
    """Sum over the clade of a spread of the children's sizes, a node's size being the sum of ln(children + e)."""
    counted = mark_num_children(df.drop(mark_as), mark_as="_n")
    sized = up(counted, {"_size": (F.log(F.col("_n") + math.e), "sum")})
    return _kept(df, up(spread(sized), {mark_as: ("_local", "sum")}), mark_as)


def mark_colless_like_index_mdm(df: DataFrame, *, mark_as: str = "colless_like_index_mdm") -> DataFrame:
    """Mean absolute deviation of the children's sizes from their median."""

    def spread(sized: DataFrame) -> DataFrame:
        middle = with_parent(with_children(sized, _median=F.median("_size")), _middle="_median")
        off = F.abs(F.col("_size") - F.col("_middle"))
        return with_children(middle.withColumn("_off", off), _mean=F.avg("_off")).withColumn("_local", F.when(F.col("_n") > 1, F.col("_mean")))

    return _colless_like(df, mark_as, spread)


def mark_colless_like_index_sd(df: DataFrame, *, mark_as: str = "colless_like_index_sd") -> DataFrame:
    return _colless_like(df, mark_as, lambda sized: with_children(sized, _local=F.stddev_samp("_size")))


def mark_colless_like_index_var(df: DataFrame, *, mark_as: str = "colless_like_index_var") -> DataFrame:
    return _colless_like(df, mark_as, lambda sized: with_children(sized, _local=F.var_samp("_size")))


def _ratio_to_sister(df: DataFrame, measured: DataFrame, mark_as: str, value: Column) -> DataFrame:
    """A value over the sister's; over itself for a root."""
    w = siblings(measured)
    out = measured.withColumn("_value", value.cast("double"))
    other = F.when(is_root(), F.col("_value")).otherwise(F.coalesce(F.lead("_value").over(w), F.lag("_value").over(w)))
    return _kept(df, out.withColumn(mark_as, ieee_div(F.col("_value"), other)), mark_as)


@_bifurcating
def mark_clade_nodecount_ratio_sister(df: DataFrame, *, mark_as: str = "clade_nodecount_ratio_sister") -> DataFrame:
    return _ratio_to_sister(df, mark_num_descendants(df.drop(mark_as), mark_as="_m"), mark_as, F.col("_m") + 1)


@_bifurcating
def mark_clade_leafcount_ratio_sister(df: DataFrame, *, mark_as: str = "clade_leafcount_ratio_sister") -> DataFrame:
    return _ratio_to_sister(df, mark_num_leaves(df.drop(mark_as), mark_as="_m"), mark_as, F.col("_m"))


@_bifurcating
def mark_clade_duration_ratio_sister(df: DataFrame, *, mark_as: str = "clade_duration_ratio_sister") -> DataFrame:
    return _ratio_to_sister(df, mark_clade_duration(df.drop(mark_as), mark_as="_m"), mark_as, F.col("_m"))


@_bifurcating
def mark_clade_subtended_duration_ratio_sister(df: DataFrame, *, mark_as: str = "clade_subtended_duration_ratio_sister") -> DataFrame:
    return _ratio_to_sister(df, mark_clade_subtended_duration(df.drop(mark_as), mark_as="_m"), mark_as, F.col("_m"))
