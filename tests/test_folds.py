import math

import pytest
from pyspark.sql import functions as F
from trees import children, clade, lineage, shapes, table

from grove.plans.folds import down, euler, largest_tree, up


def value(i):
    return i * 37 % 11 - 5


@pytest.mark.parametrize("engine", ["kernel", "doubling"])
@pytest.mark.parametrize("name", ["empty", "one", "two_roots", "chain", "star", "forest", "sparse"])
def test_folds_against_brute_force(spark, name, engine):
    edges = shapes()[name]
    df = table(spark, edges, v=value, x=lambda i: float(value(i)))
    marked = F.when(F.col("v") > 1, F.col("id"))
    ups = up(df, {"s": ("v", "sum"), "m": ("x", "max"), "n": ("v", "min")}, engine=engine)
    downs = down(ups, {"ds": ("v", "sum"), "dm": ("x", "max"), "r": ("id", "first"), "l": (marked, "last"), "p": ("x", "prod")}, engine=engine)
    rows = downs.collect()
    assert len(rows) == len(edges)
    for r in rows:
        below, above = [value(j) for j in clade(edges, r.id)], lineage(edges, r.id)
        assert (r.s, r.m, r.n) == (sum(below), max(below), min(below))
        assert (r.ds, r.dm, r.r) == (sum(map(value, above)), max(map(value, above)), above[-1])
        assert r.l == next((j for j in above if value(j) > 1), None)
        assert math.isclose(r.p, math.prod(map(value, above)), abs_tol=1e-9)


@pytest.mark.parametrize("engine", ["kernel", "doubling"])
@pytest.mark.parametrize("name", ["one", "chain", "balanced", "forest", "sparse"])
def test_walk_numbers(spark, name, engine):
    edges = shapes()[name]
    pre, post = [], []

    def visit(i):
        pre.append(i)
        for c in children(edges, i):
            visit(c)
        post.append(i)

    for root in sorted(i for i, a in edges if i == a):
        visit(root)
    rows = {r.id: r for r in euler(table(spark, edges), engine=engine).collect()}
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1].pre)] == pre
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1].post)] == post
    assert all(rows[i].size == len(clade(edges, i)) and rows[i].depth == len(lineage(edges, i)) - 1 for i, _ in edges)


def test_trees_by_key_and_choice_of_engine(spark):
    a, b = shapes()["random"], shapes()["chain"]
    df = table(spark, a).withColumn("tree_id", F.lit(1)).unionByName(table(spark, b).withColumn("tree_id", F.lit(2)))
    assert largest_tree(df) == 60
    for limit in (10, 1000):
        rows = {(r.tree_id, r.id): r.n for r in up(df, {"n": (F.lit(1), "sum")}, limit=limit).collect()}
        assert rows == {(1, i): len(clade(a, i)) for i, _ in a} | {(2, i): len(clade(b, i)) for i, _ in b}


def test_small_ids_keep_their_type(spark):
    df = table(spark, shapes()["random"]).selectExpr("cast(id as int) id", "cast(ancestor_id as int) ancestor_id")
    for engine in ("kernel", "doubling"):
        assert dict(up(df, {"n": (F.lit(1), "sum")}, engine=engine).dtypes)["id"] == "int"


def test_orphans_are_refused(spark):
    with pytest.raises(Exception, match="no id of its tree"):
        up(table(spark, [(0, 0), (1, 9)]), {"n": (F.lit(1), "sum")}, engine="kernel").collect()
