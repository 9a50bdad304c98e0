"""Connected components of an edge table, by contraction.

While more than ``bound`` edges are left, a round contracts the graph: each
node takes the first of its neighbours and itself, in an order that changes
from round to round (ids, then hashes), as its representative, and the edges
between representatives are kept. Stars fall together in one round of the
first kind, and any graph loses a share of its nodes in the mean of one of the
second. What is left, at most ``bound`` edges of 16 bytes, is solved by one
task. Rounds are written tables, and joins merge: of the graph itself only
counts of edges reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.scratch import Scratch

#: Edges that one task solves: 16 MB, and about ten times that while it works.
BOUND = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v) and the least node that each one reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        high, low = np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b])
        open_ = high != low
        if not open_.any():
            return nodes, nodes[parent]
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])  # roots are hung below lesser ones
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if columns:
        nodes, labels = least_labels(*(np.concatenate(x) for x in zip(*columns, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], ["id", "component"])


def _contracted(edges: DataFrame, turn: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, component) after one round, and the edges that are left."""
    rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(turn)))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("m"), F.min(rank("v")).alias("r"))
    chosen = F.when(rank("u") <= F.col("r"), F.col("u")).otherwise(F.col("m"))
    names = scratch.write(first.select(F.col("u").alias("id"), chosen.alias("component")), f"{name}-names-{turn}")
    # A hub's edges may fill a partition of these joins: the optimiser splits it, its one row of names is copied.
    moved = edges.join(names.toDF("u", "x").hint("merge"), "u").join(names.toDF("v", "y").hint("merge"), "v")
    return names, _distinct(moved.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _distinct(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components", bound: int = BOUND) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is the least id reachable."""
    edges, names = scratch.write(_distinct(links), f"{name}-edges"), []
    while edges.count() > bound:
        names_now, left = _contracted(edges, len(names), scratch, name)
        edges = scratch.write(left, f"{name}-left-{len(names)}")
        names.append(names_now)
    out = scratch.write(edges.coalesce(1).mapInArrow(_solved, "id long, component long"), f"{name}-solved")
    if not names:
        return out
    for before in reversed(names):
        known = out.select(F.col("id").alias("component"), F.col("component").alias("further"))
        out = before.join(known.hint("merge"), "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    # Representatives are arbitrary members: the least member names the component.
    least = out.groupBy("component").agg(F.min("id").alias("least"))
    return scratch.write(out.join(least.hint("merge"), "component").select("id", F.col("least").alias("component")), f"{name}-all")
