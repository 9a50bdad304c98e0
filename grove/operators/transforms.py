"""Transforms that insert, delete or re-point nodes.

Results are tables of the same columns. New ids start behind the largest one
of their tree. ``ancestor_list``, where there is one, is rebuilt. Nearest kept
ancestors are folds along lineages, so a run of any length is one fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions.columns import is_root, make_ancestor_list
from grove.operators.checks import position, topological_sensitivity_warned
from grove.operators.marks import mark_leaves, mark_node_depth, mark_num_children, with_parent
from grove.operators.pedigree import has_one_parent, kept_of_mask, relax, root, without_unifurcations
from grove.plans.folds import down, euler, keys, up
from grove.plans.lookup import look_up
from grove.plans.numbering import before_in_group, numbered
from grove.plans.scratch import cut


def _finish(df: DataFrame, out: DataFrame, token: str = "none") -> DataFrame:
    """The columns of ``df``, types of ids as there, lists rebuilt."""
    for c in ("id", "ancestor_id"):
        if c not in df.columns:
            continue
        out = out.withColumn(c, F.col(c).cast(df.schema[c].dataType))
    if "ancestor_list" in df.columns and has_one_parent(df):
        out = out.withColumn("ancestor_list", make_ancestor_list(F.col("id"), F.col("ancestor_id"), token))
    return out.select(df.columns)


def _on_root(df: DataFrame, root_id: str, where: Column) -> DataFrame:
    """Rows that meet the condition hang on the one that column ``root_id`` names."""
    if has_one_parent(df):
        return df.withColumn("ancestor_id", F.when(where, F.col(root_id)).otherwise(F.col("ancestor_id")))
    return df.withColumn("ancestor_list", F.when(where, F.concat(F.lit("["), F.col(root_id).cast("string"), F.lit("]"))).otherwise(F.col("ancestor_list")))


def _keep(df: DataFrame, kept: Column) -> DataFrame:
    """Drop rows; what stays hangs on its nearest ancestor that stays, or is a root."""
    marked = df.withColumn("_at", F.when(kept, F.col("id")))
    near = with_parent(down(marked, {"_near": ("_at", "last")}), _above="_near")
    staying = near.filter(F.col("_at").isNotNull())
    return staying.withColumn("ancestor_id", F.when(is_root(), F.col("id")).otherwise(F.coalesce("_above", "id")))


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def collapse_unifurcations(df: DataFrame, root_ancestor_token: str = "none") -> DataFrame:
    """Without non-root nodes of one child (and one parent); ids stay."""
    if not has_one_parent(df):
        return without_unifurcations(df, root_ancestor_token)
    counted = mark_num_children(df, mark_as="_n")
    return _finish(df, _keep(counted, (F.col("_n") != 1) | is_root()), root_ancestor_token)


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def delete_unifurcating_roots(df: DataFrame, root_ancestor_token: str = "none") -> DataFrame:
    """Without roots of one child, which becomes a root; one level only."""
    counted = mark_num_children(df, mark_as="_n").withColumn("_gone", is_root() & (F.col("_n") == 1))
    above = with_parent(counted, _orphan="_gone").filter(~F.col("_gone"))
    return _finish(df, above.withColumn("ancestor_id", F.when(F.col("_orphan"), F.col("id")).otherwise(F.col("ancestor_id"))), root_ancestor_token)


def _trunk(df: DataFrame) -> DataFrame:
    """With the parent's trunk mark; ValueError where trunk hangs on what is none."""
    out = with_parent(df, _on_trunk="is_trunk")
    if out.filter("is_trunk and not _on_trunk").limit(1).count():
        raise ValueError("the trunk is in several pieces")
    return out


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def collapse_trunk(df: DataFrame) -> DataFrame:
    """All trunk rows as one, the oldest trunk root."""
    out, k = _trunk(df), keys(df)
    first = F.struct(*(["origin_time"] if "origin_time" in df.columns else []), "id")
    oldest = df.filter(F.col("is_trunk") & is_root()).groupBy(*k).agg(F.min(first)["id"].alias("_trunk"))
    out = out.join(oldest, k, "left") if k else out.crossJoin(F.broadcast(df.agg(F.min(F.when(F.col("is_trunk") & is_root(), first))["id"].alias("_trunk"))))
    kept = out.filter(~F.col("is_trunk") | (F.col("id") == F.col("_trunk")))
    return _finish(df, kept.withColumn("ancestor_id", F.when(F.col("_on_trunk") & F.col("_trunk").isNotNull(), F.col("_trunk")).otherwise(F.col("ancestor_id"))))


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def delete_trunk(df: DataFrame) -> DataFrame:
    """Without trunk rows; what hung on them becomes a root."""
    out = _trunk(df).filter(~F.col("is_trunk"))
    return _finish(df, out.withColumn("ancestor_id", F.when(F.col("_on_trunk"), F.col("id")).otherwise(F.col("ancestor_id"))))


@topological_sensitivity_warned(insert=False, delete=True, update=False)
def prune_extinct_lineages(df: DataFrame, *, criterion: str = "extant") -> DataFrame:
    """Rows that are marked or have a marked descendant."""
    return up(df, {"_alive": (F.when(F.col(criterion), 1).otherwise(0), "max")}).filter("_alive > 0").select(df.columns)


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def coarsen_mask(df: DataFrame, mask: str | Column) -> DataFrame:
    """Masked rows, each on its nearest masked ancestor, or on all such with several parents."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return _finish(df, _keep(df, mask)) if has_one_parent(df) else kept_of_mask(df, mask)


#: Aggregates of single columns, and columns that have none.
OVERRIDES = {"destruction_time": "last", "is_root": "first", "origin_time": "first"}
WITHOUT = ("ancestor_id", "ancestor_list", "branch_length", "edge_length", "id", "is_leaf")


def coarsen_taxa_make_agg(df: DataFrame, default_agg: str = "first") -> dict[str, str]:
    return {c: OVERRIDES.get(c, default_agg) for c in df.columns if c not in (*WITHOUT, *keys(df))}


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def coarsen_taxa(df: DataFrame, *, by: str | Sequence[str], agg: Mapping[str, str] | None = None) -> DataFrame:
    """Runs of parents and children with equal ``by`` values as one row; first and last go by row order."""
    by = [by] if isinstance(by, str) else list(by)
    agg, k, pos = dict(agg or coarsen_taxa_make_agg(df)), keys(df), position(df)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_up_{c}"))
    runs = with_parent(df, **{f"_up_{c}": c for c in by}).withColumn("_founds", F.when(is_root() | ~same, F.col("id")))
    runs = with_parent(down(runs, {"_run": ("_founds", "last")}), _above="_run")
    how = {"first": lambda c: F.min_by(c, pos), "last": lambda c: F.max_by(c, pos)}
    made = [(how[f](c) if f in how else getattr(F, f)(c)).alias(c) for c, f in agg.items() if c != pos or c not in ("id",)]
    rows = runs.groupBy(*k, F.col("_run").alias("id")).agg(*made, F.max(F.when(F.col("id") == F.col("_run"), F.when(is_root(), F.col("id")).otherwise(F.col("_above")))).alias("ancestor_id"))
    out = rows
    if "ancestor_list" in df.columns:
        out = out.withColumn("ancestor_list", make_ancestor_list(F.col("id"), F.col("ancestor_id")))
    return out.select(*(c for c in df.columns if c in out.columns))


@topological_sensitivity_warned(insert=False, delete=True, update=True)
def coarsen_dilate(df: DataFrame, *, criterion: str = "origin_time", dilation: int = 1) -> DataFrame:
    """Inner nodes' criterion at its floor multiple of ``dilation``; runs of equal ones are merged, leaves never move."""
    if dilation <= 0:
        raise ValueError("dilation must be positive")
    if criterion in ("id", "ancestor_id"):
        raise ValueError(f"criterion cannot be {criterion}")
    kind = df.schema[criterion].dataType
    leaves = mark_leaves(df, mark_as="_leaf")
    snapped = F.when(F.col("_leaf"), F.col(criterion)).otherwise((F.floor(F.col(criterion) / dilation) * dilation).cast(kind))
    moved = leaves.withColumn("_snapped", snapped)
    merges = ~is_root() & ~F.col("_leaf") & (F.col("_snapped") == F.col("_up"))
    marked = with_parent(moved, _up="_snapped").withColumn("_stays", ~F.coalesce(merges, F.lit(False)))
    return _finish(df, _keep(marked.withColumn(criterion, F.col("_snapped")), F.col("_stays")))


def _numbered(df: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``_new``: ids behind the largest of the tree, in the order of ``by``."""
    k = keys(df)
    largest = df.groupBy(*k).agg(F.max("id").alias("_max"))
    joined = rows.join(largest, k) if k else rows.crossJoin(F.broadcast(largest))  # one row
    return numbered(joined, list(by), "_new").withColumn("_new", F.col("_max") + 1 + F.col("_new")).drop("_max")


@topological_sensitivity_warned(insert=True, delete=False, update=True)
def splay_polytomies(df: DataFrame) -> DataFrame:
    """k > 2 children as a chain of k - 2 new nodes that copy their parent's columns.

    The child of rank r hangs on chain node min(r - 1, k - 2), node 0 being
    the parent and each other one hanging on the one before.
    """
    k, others = keys(df), [c for c in df.columns if c not in (*keys(df), "id", "ancestor_id")]
    below = df.filter(~is_root()).select(*k, "id", "ancestor_id", F.lit(1).alias("_one"))
    counts = below.groupBy(*k, "ancestor_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 2")
    ranked = before_in_group(below, [*k, "ancestor_id"], ["id"], "_j", sum_of="_one")
    # The child of rank j + 1 brings chain node j along, the last one none: no row is spread into many.
    several = look_up(ranked, counts, [*k, "ancestor_id"]).filter((F.col("_k") > 2) & (F.col("_j") > 0))
    made = several.withColumn("_makes", F.when(F.col("_j") <= F.col("_k") - 2, 1).otherwise(0))
    largest = df.groupBy(*k).agg(F.max("id").alias("_max"))
    made = made.join(largest, k) if k else made.crossJoin(F.broadcast(largest))  # one row
    made, _ = cut(numbered(made, ["ancestor_id", "id"], "_to", sum_of="_makes").withColumn("_to", F.col("_max") + F.col("_to") + F.col("_makes")))
    on = F.when(F.col("_j") == 1, F.col("ancestor_id")).otherwise(F.col("_to") - 1)
    chain = made.filter("_makes > 0").select(*k, F.col("ancestor_id").alias("_of"), F.col("_to").alias("id"), on.alias("ancestor_id"))
    new = look_up(chain, df.select(*k, F.col("id").alias("_of"), *others), [*k, "_of"])
    old = df.join(made.select(*k, "id", "_to"), [*k, "id"], "left").withColumn("ancestor_id", F.coalesce("_to", "ancestor_id"))
    return _finish(df, old.select(df.columns).unionByName(new.select(df.columns)))


@topological_sensitivity_warned(insert=True, delete=False, update=True)
def add_global_root(df: DataFrame, root_attrs: Mapping[str, Any] | None = None) -> DataFrame:
    """One new root above all roots; its other columns are ``root_attrs`` or null."""
    attrs, k = dict(root_attrs or {}), keys(df)
    if set(attrs) & {"id", "ancestor_id", "ancestor_list", *k}:
        raise ValueError("root_attrs cannot name ids")
    top = (df.groupBy(*k) if k else df.groupBy()).agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long").alias("id"))
    own = {"ancestor_id": F.col("id")} if has_one_parent(df) else {"ancestor_list": F.lit("[none]")}
    new = top.withColumns({**own, **{n: F.lit(v) for n, v in attrs.items()}})
    named = top.withColumnRenamed("id", "_root")
    old = df.join(named, k) if k else df.crossJoin(F.broadcast(named))  # one row
    old = _on_root(old, "_root", root(df)).drop("_root")
    out = old.unionByName(new, allowMissingColumns=True)
    wide = df.limit(0).unionByName(new.limit(0), allowMissingColumns=True)
    return _finish(wide, out)


@topological_sensitivity_warned(insert=False, delete=False, update=True)
def join_roots(df: DataFrame) -> DataFrame:
    """All roots on the oldest one."""
    from grove.operators.marks import mark_oldest_root

    k = keys(df)
    oldest = mark_oldest_root(df, mark_as="_o").filter("_o").select(*k, F.col("id").alias("_oldest"))
    joined = df.join(oldest, k) if k else df.crossJoin(F.broadcast(oldest))  # one row
    return _finish(df, _on_root(joined, "_oldest", root(df) & (has_one_parent(df) | (F.col("id") != F.col("_oldest")))))


@topological_sensitivity_warned(insert=True, delete=False, update=True)
def prefix_roots(df: DataFrame, *, allow_id_reassign: bool = False, origin_time: float | None = None) -> DataFrame:
    """A new root above each root that is later than ``origin_time`` (above all without one)."""
    if origin_time is not None and "origin_time" not in df.columns:
        raise ValueError("there is no origin_time")
    k = keys(df)
    eligible = is_root() & (F.col("origin_time") > origin_time if origin_time is not None else F.lit(True))
    roots = _numbered(df, df.filter(eligible).select(*k, "id"), ["id"]).withColumnRenamed("id", "_old")
    new = roots.select(*k, F.col("_new").alias("id"), F.col("_new").alias("ancestor_id"))
    if "origin_time" in df.columns:
        new = new.withColumn("origin_time", F.lit(origin_time or 0).cast(df.schema["origin_time"].dataType))
    placed = roots.select(*k, F.col("_old").alias("id"), "_new")
    old = df.join(placed, [*k, "id"], "left").withColumn("ancestor_id", F.coalesce("_new", "ancestor_id")).drop("_new")
    out = _finish(df, old.unionByName(new, allowMissingColumns=True))
    if not allow_id_reassign:
        return out
    # New roots first, all others behind them.
    n = roots.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.min("_new").alias("_least"))
    both = out.join(n, k, "left") if k else out.crossJoin(F.broadcast(n))  # one row
    shift = lambda c: F.when(F.col("_n").isNull(), F.col(c)).when(F.col(c) >= F.col("_least"), F.col(c) - F.col("_least")).otherwise(F.col(c) + F.col("_n"))
    return _finish(df, both.withColumns({c: shift(c) for c in ("id", "ancestor_id")}))


def _inner(df: DataFrame) -> DataFrame:
    return mark_leaves(df, mark_as="_leaf").filter(~F.col("_leaf")).drop("_leaf")


@topological_sensitivity_warned(insert=True, delete=False, update=False)
def add_inner_leaves(df: DataFrame) -> DataFrame:
    """A leaf of no length on each inner node, with its columns."""
    new = _numbered(df, _inner(df), ["id"])
    new = new.withColumns({"ancestor_id": F.col("id"), "id": F.col("_new")}).select(df.columns)
    return _finish(df, df.unionByName(new))


def _shifted(df: DataFrame) -> DataFrame:
    """With ``_by``: the largest id plus one."""
    k = keys(df)
    largest = df.groupBy(*k).agg((F.max("id") + 1).alias("_by"))
    return df.join(largest, k) if k else df.crossJoin(F.broadcast(largest))  # one row


@topological_sensitivity_warned(insert=True, delete=False, update=True)
def add_inner_knuckles(df: DataFrame) -> DataFrame:
    """A node of one child above each inner node, id + largest id + 1, with its columns."""
    k = keys(df)
    inner = _inner(_shifted(df))
    new = inner.withColumn("ancestor_id", F.when(is_root(), F.col("id") + F.col("_by")).otherwise(F.col("ancestor_id"))).withColumn("id", F.col("id") + F.col("_by"))
    placed = inner.select(*k, "id", (F.col("id") + F.col("_by")).alias("_knuckle"))
    old = df.join(placed, [*k, "id"], "left").withColumn("ancestor_id", F.coalesce("_knuckle", "ancestor_id"))
    return _finish(df, old.select(df.columns).unionByName(new.select(df.columns)))


@topological_sensitivity_warned(insert=True, delete=False, update=True)
def add_inner_niblings(df: DataFrame) -> DataFrame:
    """Knuckles, and a leaf on the knuckle of each inner node at odd depth."""
    knuckles = add_inner_knuckles(df, ignore_topological_sensitivity=True)
    deep = _inner(mark_node_depth(_shifted(knuckles), mark_as="_d")).filter("_d % 2 = 1")
    new = deep.withColumn("id", F.col("id") + F.col("_by")).select(df.columns)
    return _finish(df, knuckles.unionByName(new))


@topological_sensitivity_warned(insert=False, delete=False, update=True)
def reroot_at_id(df: DataFrame, new_root_id: int) -> DataFrame:
    """Parents reversed on the way from the new root to the old one; lengths stay as they are."""
    k = keys(df)
    walked = euler(df.select(*k, "id", "ancestor_id"))
    here = walked.filter(F.col("id") == new_root_id).select(*k, F.col("pre").alias("_p"))
    both = walked.join(here, k) if k else walked.crossJoin(F.broadcast(here))  # one row
    path = both.filter((F.col("pre") <= F.col("_p")) & (F.col("_p") < F.col("pre") + F.col("size"))).select(*k, "id", "ancestor_id")
    turned = path.filter(~is_root()).select(*k, F.col("ancestor_id").alias("id"), F.col("id").alias("_to"))
    top = here.select(*k, F.lit(new_root_id).cast("long").alias("id"), F.lit(new_root_id).cast("long").alias("_to"))
    out = df.join(turned.unionByName(top), [*k, "id"], "left").withColumn("ancestor_id", F.coalesce("_to", "ancestor_id"))
    return _finish(df, out)


def ultrametricize(df: DataFrame, *, method: str = "extend") -> DataFrame:
    """Tips' origin_time at the latest one."""
    if method != "extend":
        raise ValueError("the only method is extend")
    k = keys(df)
    last = df.groupBy(*k).agg(F.max("origin_time").alias("_last"))
    out = mark_leaves(df, mark_as="_leaf")
    out = out.join(last, k) if k else out.crossJoin(F.broadcast(last))  # one row
    return out.withColumn("origin_time", F.when(F.col("_leaf"), F.col("_last")).otherwise(F.col("origin_time"))).select(df.columns)


def coerce_chronological_consistency(df: DataFrame) -> DataFrame:
    """No node earlier than its ancestors: origin_time is the latest on the way from the root."""
    kind = df.schema["origin_time"].dataType
    if not has_one_parent(df):
        times = relax(df, F.col("origin_time")).withColumnRenamed("value", "_t")
        return df.join(times, [*keys(df), "id"]).withColumn("origin_time", F.col("_t").cast(kind)).select(df.columns)
    return down(df, {"_t": ("origin_time", "max")}).withColumn("origin_time", F.col("_t").cast(kind)).select(df.columns)
