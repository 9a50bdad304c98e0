"""Large trees: raking, and parents of very many children, against brute force."""

import math

import pytest
from pyspark.sql import functions as F
from trees import children, clade, lineage, shapes, table

from grove.plans import lookup
from grove.plans.folds import down, euler, up
from grove.plans.numbering import before_in_group


def value(i):
    return i * 37 % 11 - 5


@pytest.fixture(autouse=True)
def few_are_many(monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 3)


@pytest.mark.parametrize("name, limit", [("empty", 0), ("two_roots", 0), ("chain", 9), ("star", 1), ("comb", 4), ("forest", 6), ("sparse", 3)])
def test_raking_against_brute_force(spark, name, limit):
    edges = shapes()[name]
    df = table(spark, edges, v=value, x=lambda i: float(value(i)))
    marked = F.when(F.col("v") > 1, F.col("id"))
    ups = up(df, {"s": ("v", "sum"), "m": ("x", "max"), "n": ("v", "min")}, engine="raking", limit=limit)
    downs = down(ups, {"ds": ("v", "sum"), "dm": ("x", "max"), "r": ("id", "first"), "l": (marked, "last"), "p": ("x", "prod")}, engine="raking", limit=limit)
    rows = downs.collect()
    assert len(rows) == len(edges)
    for r in rows:
        below, above = [value(j) for j in clade(edges, r.id)], lineage(edges, r.id)
        assert (r.s, r.m, r.n) == (sum(below), max(below), min(below))
        assert (r.ds, r.dm, r.r) == (sum(map(value, above)), max(map(value, above)), above[-1])
        assert r.l == next((j for j in above if value(j) > 1), None)
        assert math.isclose(r.p, math.prod(map(value, above)), abs_tol=1e-9)


@pytest.mark.parametrize("name, descending", [("star", False), ("forest", True), ("sparse", False)])
def test_walk_numbers_of_raked_trees(spark, name, descending):
    edges, pre, post = shapes()[name], [], []

    def visit(i):
        pre.append(i)
        for c in sorted(children(edges, i), reverse=descending):
            visit(c)
        post.append(i)

    for root in sorted((i for i, a in edges if i == a), reverse=descending):
        visit(root)
    rows = {r.id: r for r in euler(table(spark, edges), descending=descending, engine="raking", limit=5).collect()}
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1].pre)] == pre
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1].post)] == post


def test_trees_of_other_keys_are_raked_apart(spark):
    a, b = shapes()["random"], shapes()["chain"]
    df = table(spark, a).withColumn("tree_id", F.lit(1)).unionByName(table(spark, b).withColumn("tree_id", F.lit(2)))
    rows = {(r.tree_id, r.id): r for r in euler(down(df, {"n": (F.lit(1), "sum")}, limit=8), limit=8).collect()}
    assert {key: r.n for key, r in rows.items()} == {(t, i): len(lineage(e, i)) for t, e in ((1, a), (2, b)) for i, _ in e}
    assert {key: r.size for key, r in rows.items()} == {(t, i): len(clade(e, i)) for t, e in ((1, a), (2, b)) for i, _ in e}


def test_a_parent_of_many_rows_does_not_gather_them(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")).alias("ancestor_id")).repartition(4)
    table_ = spark.range(500).select(F.col("id").alias("ancestor_id"), (F.col("id") * 2).alias("v"))
    out = lookup.look_up(rows, table_, ["ancestor_id"])
    assert {r.id: r.v for r in out.collect()} == {i: (14 if i % 10 else i * 2 if i < 500 else None) for i in range(1000)}
    light = rows.join(out.filter("ancestor_id = 7").select("id"), "id", "left_anti").count()
    assert light == 100 and "left_anti" in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftanti", "left_anti")


def test_sums_within_groups_that_lie_in_several_parts(spark):
    rows = [(i % 7 // 5, i, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, id long, v long").repartition(3)
    for by, back in ((F.col("id"), False), (F.col("id").desc(), True)):
        got = {r.id: r.s for r in before_in_group(df, ["g"], [by], "s", sum_of="v").collect()}
        passed = {0: 0, 1: 0}
        for g, i, v in sorted(rows, reverse=back):
            assert got[i] == passed[g]
            passed[g] += v
    plan = before_in_group(df, ["g"], ["id"], "s", sum_of="v")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line.rpartition("windowspecdefinition(")[2].split(",")[0] for line in plan.splitlines() if "Window [" in line)
