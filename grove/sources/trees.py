"""Trees made by rule, and unions of trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TREE = "id long, ancestor_id long"


def make_empty(spark: SparkSession, *, ancestor_id: bool = True) -> DataFrame:
    return spark.createDataFrame([], f"ancestor_list string, {_TREE}" if ancestor_id else "ancestor_list string, id long")


def make_balanced_bifurcating(spark: SparkSession, depth: int) -> DataFrame:
    """All 2^depth - 1 nodes of a full binary tree, level by level."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    return spark.range(2**depth - 1).select("id", F.greatest(F.floor((F.col("id") - 1) / 2), F.lit(0)).cast("long").alias("ancestor_id"))


def make_comb(spark: SparkSession, n_leaves: int) -> DataFrame:
    """A caterpillar: each even node but the last carries a leaf (odd) and the next even node."""
    if n_leaves < 0:
        raise ValueError("n_leaves must not be negative")
    return spark.range(max(2 * n_leaves - 1, 0)).select("id", F.greatest(F.floor((F.col("id") - 1) / 2) * 2, F.lit(0)).cast("long").alias("ancestor_id"))


def make_star(spark: SparkSession, n_leaves: int) -> DataFrame:
    if n_leaves < 0:
        raise ValueError("n_leaves must not be negative")
    return spark.range(n_leaves + 1 if n_leaves > 1 else n_leaves).select("id", F.lit(0).cast("long").alias("ancestor_id"))


def _grown(spark: SparkSession, n_trees: int, schema: str, make) -> DataFrame:
    """Trees from a sequential random process, one task a tree."""

    def run(table: pa.Table) -> pa.Table:
        tree = table["tree_id"][0].as_py()
        parents = make(tree)
        return pa.table({"tree_id": np.full(len(parents), tree), "id": np.arange(len(parents)), "ancestor_id": parents})

    return spark.range(n_trees).withColumnRenamed("id", "tree_id").groupBy("tree_id").applyInArrow(run, f"tree_id long, {_TREE}")


def make_leaf_split(spark: SparkSession, n_leaves: int, *, seed: int = 0, n_trees: int = 1) -> DataFrame:
    """Random trees where each step splits a leaf, all alike likely: step i adds nodes 2i + 1 and 2i + 2."""

    def make(tree: int) -> np.ndarray:
        parents, leaves = np.zeros(max(2 * n_leaves - 1, 0), np.int64), [0]
        draws = np.random.default_rng([seed, tree]).random(max(n_leaves - 1, 0))
        for i, u in enumerate(draws):
            at = int(u * len(leaves))
            parents[2 * i + 1 : 2 * i + 3] = leaves[at]
            leaves[at] = 2 * i + 1
            leaves.append(2 * i + 2)
        return parents

    out = _grown(spark, n_trees, _TREE, make)
    return out.drop("tree_id") if n_trees == 1 else out


def make_edge_split(spark: SparkSession, n_leaves: int, *, seed: int = 0, n_trees: int = 1) -> DataFrame:
    """Random trees where each step puts a new leaf on an edge, all alike likely; the root has an edge above it."""

    def make(tree: int) -> np.ndarray:
        if not n_leaves:
            return np.zeros(0, np.int64)
        # Node 0 is the root; an edge is named by its lower node, and the edge above the tree by its topmost node.
        parents, top = [0], 0
        for i, u in enumerate(np.random.default_rng([seed, tree]).random(n_leaves - 1)):
            low = int(u * (2 * i + 1))
            inner, leaf = 2 * i + 1, 2 * i + 2
            parents += [inner if low == top else parents[low], inner]
            top, parents[low] = (inner if low == top else top), inner
            assert len(parents) == leaf + 1
        swap = {top: 0, 0: top}  # the root is node 0
        out = np.zeros(len(parents), np.int64)
        for node, parent in enumerate(parents):
            out[swap.get(node, node)] = swap.get(parent, parent)
        return out

    out = _grown(spark, n_trees, _TREE, make)
    return out.drop("tree_id") if n_trees == 1 else out


def aggregate_phylogenies(frames: list[DataFrame], *, offset_ids: bool = True) -> DataFrame:
    """Independent trees in one table: ``tree_id`` tells them apart, and with ``offset_ids`` ids of a tree follow those before it."""
    if not frames:
        raise ValueError("no tables to put together")
    tagged = [f.withColumn("tree_id", F.lit(i).cast("long")) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if not offset_ids:
        return out
    sizes = out.groupBy("tree_id").agg((F.max("id") + 1).alias("_n"))  # a row for each table
    before = F.coalesce(F.sum("_n").over(Window.orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = out.join(F.broadcast(sizes.select("tree_id", before.alias("_by"))), "tree_id")
    moved = shifted.withColumn("id", F.col("id") + F.col("_by"))
    if "ancestor_id" in out.columns:
        moved = moved.withColumn("ancestor_id", F.col("ancestor_id") + F.col("_by"))
        if "ancestor_list" in out.columns:
            from grove.functions.columns import make_ancestor_list

            moved = moved.withColumn("ancestor_list", make_ancestor_list(F.col("id"), F.col("ancestor_id")))
    elif "ancestor_list" in out.columns:
        from grove.functions.columns import parse_ancestor_ids
        from grove.operators.pedigree import list_text

        moved = moved.withColumn("ancestor_list", list_text(F.transform(parse_ancestor_ids(F.col("ancestor_list")), lambda x: x + F.col("_by"))))
    return moved.select(out.columns)
