"""Numbering without a whole table in a task, and operators beyond the bound of a one-task kernel."""

import random

import pytest
from pyspark.sql import functions as F

from grove.operators import marks, orders, representation, sampling, traits
from grove.plans.numbering import numbered, running
from trees import lineage, shapes, table


def test_numbers_sums_and_values_before(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40) if i % 9 else None, i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b long, v long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r.b: r for r in numbered(numbered(df, ["a", "b"], "n"), ["a", "b"], "s", sum_of="v").collect()}
    passed = 0
    for n, (_, b, v) in enumerate(order):
        assert (got[b].n, got[b].s) == (n, passed)
        passed += v
    before = {r.b: r.p for r in numbered(df, ["b"], "p", lag_of="v").collect()}
    assert before == {b: (rows[b - 1][2] if b else None) for _, b, _ in rows}
    down = {r.b: r.n for r in numbered(df, [F.desc("b")], "n").collect()}
    assert down == {b: 299 - b for _, b, _ in rows}
    low = {r.b: (r.lo, r.hi) for r in running(df, ["b"], {"lo": ("min", "v"), "hi": ("max", "v")}).collect()}
    assert all(low[b] == (min(r[2] for r in rows[: b + 1]), max(r[2] for r in rows[: b + 1])) for _, b, _ in rows)
    assert numbered(df.limit(0), ["b"], "n").count() == numbered(df.limit(0), ["b"], "n", lag_of="v").count() == 0


@pytest.mark.parametrize("name", ["csr_offsets", "csr_children", "levelorder", "postorder", "contiguous", "working", "chronological", "uniform", "canopy"])
def test_no_window_holds_a_whole_table(spark, name):
    df = table(spark, shapes()["random"], origin_time=lambda i: float(i % 7))
    made = {
        "csr_offsets": marks.mark_csr_offsets,
        "csr_children": marks.mark_csr_children,
        "levelorder": orders.unfurl_traversal_levelorder,
        "postorder": orders.unfurl_traversal_postorder,
        "contiguous": representation.assign_contiguous_ids,
        "working": representation.to_working_format,
        "chronological": representation.chronological_sort,
        "uniform": lambda x: sampling.mark_sample_tips_uniform(x, 5),
        "canopy": lambda x: sampling.mark_sample_tips_canopy(x, 5),
    }[name](df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_part" in line.rpartition("windowspecdefinition(")[2].split(",")[0], line
    assert made.count() >= 0


@pytest.mark.parametrize("shape", ["random", "chain", "comb"])
def test_beyond_the_kernels(spark, shape):
    edges = shapes()[shape]
    df = table(spark, edges, origin_time=lambda i: float(i * 31 % 17))
    times = {i: float(i * 31 % 17) for i, _ in edges}
    for delta in (0.0, 4.0, 100.0):
        want = {}
        for i, _ in edges:
            line = lineage(edges, i)
            want[i] = next((x for x in line if times[x] <= times[i] - delta), line[-1])
        for limit in (1_000, 0):
            assert {r.id: r.lookback_id for r in traits.calc_clade_lookback_origin_time_delta(df, delta, limit=limit).collect()} == want
    key = lambda rows: sorted((r.id, r.ot_mrca_id, r.ot_mrca_time_of, r.ot_mrca_time_since) for r in rows)
    want = []
    for i, _ in edges:
        lines = [lineage(edges, j) for j, _ in edges if times[j] >= times[i]]
        met = next(x for x in lines[0] if all(x in line for line in lines))
        want.append((i, met, times[met], times[i] - times[met]))
    assert key(traits.mark_ot_mrca(df).collect()) == key(traits.mark_ot_mrca(df, limit=0).collect()) == sorted(want)
