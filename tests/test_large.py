"""Operators on trees beyond a task, with parents of many rows: the results of small ones, and no task that gathers a parent's rows."""

import random

import pytest
from pyspark.sql import functions as F
from trees import shapes, table

from grove.operators import marks, orders, pairs, sampling, traits, transforms
from grove.plans import folds, lookup

RNG = random.Random(3)
EDGES = [(i, RNG.randrange(i) if i else 0) for i in range(25)] + [(i, 3) for i in range(25, 45)]
MADE = {
    "splay_polytomies": lambda df: transforms.splay_polytomies(df, ignore_topological_sensitivity=True),
    "coarsen_taxa": lambda df: transforms.coarsen_taxa(df, by="kind", ignore_topological_sensitivity=True),
    "calc_mrca_id_vector": lambda df: pairs.calc_mrca_id_vector(df, target_id=30),
    "find_mrca_id": lambda df: pairs.find_mrca_id(df, [24, 30, 31]),
    "find_pair_mrca_id": lambda df: pairs.find_pair_mrca_id(df, 24, 30),
    "find_pair_distance": lambda df: pairs.find_pair_distance(df, 24, 30),
    "unfurl_lineage": lambda df: marks.unfurl_lineage(df, 30),
    "unfurl_traversal_postorder_contiguous": lambda df: orders.unfurl_traversal_postorder_contiguous(df),
    "mark_clade_faithpd": lambda df: marks.mark_clade_faithpd(df),
    "mask_monomorphic_clades": lambda df: traits.mask_monomorphic_clades(df, trait_mask=F.col("v") < 3, trait_values="v"),
    "calc_clade_trait_frequency": lambda df: traits.calc_clade_trait_frequency(df, mask_trait_absent=F.col("v") < 2, mask_trait_present=F.col("v") > 2),
    "mark_sample_tips_lineage": lambda df: sampling.mark_sample_tips_lineage(df, 4),
    "mark_sample_tips_lineage_stratified": lambda df: sampling.mark_sample_tips_lineage_stratified(df, criterion_stratify="kind"),
    "downsample_tips_lineage": lambda df: sampling.downsample_tips_lineage(df, 4),
    "downsample_tips_lineage_stratified": lambda df: sampling.downsample_tips_lineage_stratified(df, criterion_stratify="kind"),
    "downsample_tips_clade": lambda df: sampling.downsample_tips_clade(df, 6),
}


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tree(spark):
    return table(spark, EDGES, v=lambda i: i * 7 % 5, origin_time=float, kind=lambda i: str(i % 3)).drop("pos")


@pytest.mark.parametrize("name", MADE)
def test_large_trees(tree, monkeypatch, name):
    want = rows(MADE[name](tree))
    assert want
    monkeypatch.setattr(lookup, "HEAVY", 3)
    for function in (folds.up, folds.down, folds.euler):
        monkeypatch.setitem(function.__kwdefaults__, "limit", 6)
    made = MADE[name](tree)
    assert rows(made) == want
    text = plan(made)
    assert "Generate " not in text, text
    for line in text.splitlines():  # rows of a parent, or of the whole table, lie in many parts; of strata a few rows are ranked
        if "Window [" in line and "stratified" not in name:
            assert "_part" in line.rpartition("windowspecdefinition(")[2].split(",")[0], line


def test_rows_from_a_task_of_a_whole_tree_are_dealt_out(tree):
    for made in (marks.mark_num_leaves(tree), folds.euler(tree)):
        text = plan(made)
        assert "RepartitionByExpression [id" in text and text.index("RepartitionByExpression [id") < text.index("FlatMapGroupsInArrow"), text


def test_semiorder_of_large_trees(spark, monkeypatch):
    df = table(spark, shapes()["balanced"])
    want = rows(orders.unfurl_traversal_semiorder(df))
    for function in (folds.up, folds.down):
        monkeypatch.setitem(function.__kwdefaults__, "limit", 6)
    assert rows(orders.unfurl_traversal_semiorder(df)) == want


def test_unifurcations_under_a_parent_of_many_rows(spark, monkeypatch):
    edges = [(0, "[none]"), *((i, "[0, 50]" if i % 4 else f"[{i - 1}]") for i in range(1, 30)), (50, "[0]")]
    df = spark.createDataFrame(edges, "id long, ancestor_list string")
    make = lambda: transforms.collapse_unifurcations(df, ignore_topological_sensitivity=True)
    want = rows(make())
    monkeypatch.setattr(lookup, "HEAVY", 3)
    made = make()
    assert rows(made) == want and "LeftAnti" in plan(made)
