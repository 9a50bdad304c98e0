import math
import statistics
import warnings

import pytest
from pyspark.sql import functions as F
from trees import children, clade, leaves, lineage, shapes, table

from grove.functions import columns
from grove.operators import checks, counts, marks, orders, pairs, representation, sampling, traits, transforms
from grove.plans.folds import down
from grove.sources import newick, spop, trees

COLLESS_OF_COMBS = {3: 1, 4: 3, 5: 6, 7: 15}


@pytest.mark.parametrize("n", COLLESS_OF_COMBS)
def test_colless_of_combs(spark, n):
    rows = marks.mark_colless_index(trees.make_comb(spark, n)).filter("id = 0").collect()
    assert rows[0].colless_index == COLLESS_OF_COMBS[n]


def test_colless_of_balanced_is_zero_and_polytomies_raise(spark):
    assert marks.mark_colless_index(trees.make_balanced_bifurcating(spark, 4)).agg(F.max("colless_index")).first()[0] == 0
    with pytest.raises(ValueError, match="bifurcating"):
        marks.mark_colless_index(trees.make_star(spark, 5))


def test_colless_like_against_statistics(spark):
    edges = shapes()["random"]
    size = {i: sum(math.log(len(children(edges, j)) + math.e) for j in clade(edges, i)) for i, _ in edges}

    def spread(i, how):
        s = [size[c] for c in children(edges, i)]
        return how(s) if len(s) > 1 else 0.0

    how = {"mdm": lambda s: statistics.fmean(abs(x - statistics.median(s)) for x in s), "sd": statistics.stdev, "var": statistics.variance}
    for name, f in how.items():
        column = f"colless_like_index_{name}"
        for r in getattr(marks, f"mark_{column}")(table(spark, edges)).collect():
            assert math.isclose(r[column], sum(spread(j, f) for j in clade(edges, r.id)), rel_tol=1e-9, abs_tol=1e-9)


def test_cumulative_marks_and_missing_values(spark):
    edges = shapes()["random"]
    df = table(spark, edges, x=lambda i: float("nan") if i % 9 == 4 else float(i % 7) - 3)
    value = lambda i: float("nan") if i % 9 == 4 else float(i % 7) - 3
    known = lambda ids: [value(j) for j in ids if not math.isnan(value(j))]
    for name, f, empty in (("sum", sum, 0), ("prod", math.prod, 1), ("max", max, -math.inf), ("min", min, math.inf)):
        mark = getattr(marks, f"mark_lineage_cum{name}")
        for r in mark(df, "x").collect():
            got = known(lineage(edges, r.id))
            assert math.isclose(r[f"lineage_cum{name}"], f(got) if got else empty, abs_tol=1e-9)
        for r in mark(df, "x", skipna=False, reverse=True).collect():
            ids = clade(edges, r.id)
            bad = len(known(ids)) < len(ids)
            assert math.isnan(r[f"lineage_cum{name}"]) if bad else math.isclose(r[f"lineage_cum{name}"], f(known(ids)), abs_tol=1e-9)


def test_marks_leave_no_helpers_and_replace_their_column(spark):
    df = table(spark, shapes()["balanced"], origin_time=float)
    for name in ("num_leaves", "sackin_index", "clade_duration", "sister", "num_preceding_leaves", "clade_duration_ratio_sister", "csr_children"):
        out = getattr(marks, f"mark_{name}")(df, mark_as="m")
        again = getattr(marks, f"mark_{name}")(out, mark_as="m")
        assert out.columns == again.columns == [*df.columns, "m"]
        assert sorted(out.collect()) == sorted(again.collect()) or name.endswith("ratio_sister")


@pytest.mark.parametrize("name", ["one", "chain", "star", "random", "forest", "sparse"])
def test_transforms_keep_tables_valid(spark, name):
    edges = shapes()[name]
    df = table(spark, edges, origin_time=float, extant=lambda i: i % 3 == 0)
    roots = {i for i, a in edges if i == a}
    made = {
        "collapse": transforms.collapse_unifurcations(df),
        "splay": transforms.splay_polytomies(df),
        "knuckles": transforms.add_inner_knuckles(df),
        "niblings": transforms.add_inner_niblings(df),
        "leaves": transforms.add_inner_leaves(df),
        "prefix": transforms.prefix_roots(df),
        "prefix_first": transforms.prefix_roots(df, allow_id_reassign=True),
        "top": transforms.add_global_root(df, {"origin_time": -1.0}),
        "joined": transforms.join_roots(df),
        "dilated": transforms.coarsen_dilate(df, dilation=5),
        "masked": transforms.coarsen_mask(df, F.col("id") % 2 == 0),
        "pruned": transforms.prune_extinct_lineages(df),
    }
    for k, out in made.items():
        rows = {r.id: r.ancestor_id for r in out.collect()}
        assert set(rows.values()) <= rows.keys(), k
        assert out.columns == df.columns, k
    ids = lambda k: {r.id for r in made[k].collect()}
    assert ids("collapse") == {i for i, _ in edges if i in roots or len(children(edges, i)) != 1}
    assert ids("pruned") == {i for i, _ in edges if any(j % 3 == 0 for j in clade(edges, i))}
    splayed = [(r.id, r.ancestor_id) for r in made["splay"].collect()]
    assert all(len(children(splayed, i)) <= 2 for i, _ in splayed)
    assert {i for i in leaves(splayed)} == leaves(edges)
    for i in leaves(edges):  # ancestors among old nodes stay
        assert [j for j in lineage(splayed, i) if j in dict(edges)] == lineage(edges, i)
    assert sum(r.id == r.ancestor_id for r in made["joined"].collect()) == 1


def test_transforms_with_lists_and_stale_columns(spark):
    df = representation.make_ancestor_list_col(marks.mark_num_leaves(table(spark, shapes()["chain"])))
    with pytest.warns(UserWarning, match="num_leaves"):
        out = transforms.collapse_unifurcations(df)
    assert {(r.id, r.ancestor_list) for r in out.collect()} == {(0, "[none]"), (36, "[0]")}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert "num_leaves" not in transforms.collapse_unifurcations(df, drop_topological_sensitivity=True).columns
        transforms.collapse_unifurcations(df, ignore_topological_sensitivity=True)
    assert checks.check_topological_sensitivity(marks.mark_node_depth(df), insert=True, delete=True, update=False) == ["num_leaves"]


def test_trunks(spark):
    df = spark.createDataFrame([(0, 0, True), (1, 0, True), (2, 1, False), (3, 1, False)], "id long, ancestor_id long, is_trunk boolean")
    assert {(r.id, r.ancestor_id) for r in transforms.collapse_trunk(df).collect()} == {(0, 0), (2, 0), (3, 0)}
    assert {(r.id, r.ancestor_id) for r in transforms.delete_trunk(df).collect()} == {(2, 2), (3, 3)}
    with pytest.raises(ValueError, match="pieces"):
        transforms.delete_trunk(df.withColumn("is_trunk", F.col("id") == 3).withColumn("is_trunk", (F.col("id") == 3) | (F.col("id") == 0)))


def test_reroot(spark):
    edges = shapes()["random"]
    for root in (0, 17, 59):
        out = [(r.id, r.ancestor_id) for r in transforms.reroot_at_id(table(spark, edges), root).collect()]
        undirected = lambda e: {frozenset(x) for x in e if x[0] != x[1]}
        assert undirected(out) == undirected(edges) and [i for i, a in out if i == a] == [root]


def test_coarsen_taxa(spark):
    edges = shapes()["random"]
    df = table(spark, edges, kind=lambda i: "ab"[i % 2], origin_time=float, destruction_time=lambda i: float(i + 100))
    out = {r.id: r for r in transforms.coarsen_taxa(df, by="kind").collect()}
    up_ = dict(edges)
    founder = lambda i: i if up_[i] == i or up_[i] % 2 != i % 2 else founder(up_[i])
    assert out.keys() == {founder(i) for i, _ in edges}
    for f, r in out.items():
        members = [i for i, _ in edges if founder(i) == f]
        assert (r.origin_time, r.destruction_time) == (min(members), max(members) + 100)
        assert r.ancestor_id == (f if up_[f] == f else founder(up_[f]))


@pytest.mark.parametrize("name", ["one", "balanced", "comb"])
def test_between_orders(spark, name):
    edges = shapes()[name]

    def inorder(i, first):
        c = sorted(children(edges, i), key=first)
        return [*inorder(c[0], first), i, *inorder(c[1], first)] if c else [i]

    rows = lambda df: [r.id for r in df.orderBy("ord").collect()]
    assert rows(orders.unfurl_traversal_inorder(table(spark, edges))) == inorder(0, lambda c: c)
    assert rows(orders.unfurl_traversal_semiorder(table(spark, edges))) == inorder(0, lambda c: min(leaves(edges) & set(clade(edges, c))))


def test_pairs_of_all_kinds(spark):
    edges = shapes()["forest"]
    df = table(spark, edges, origin_time=float)
    met = lambda a, b: next((i for i in lineage(edges, a) if i in lineage(edges, b)), None)
    rows = pairs.calc_mrca_id_matrix(df).collect()
    assert len(rows) == len(edges) ** 2
    assert all(r.mrca_id == (met(r.first, r.second) if met(r.first, r.second) is not None else -1) for r in rows)
    for r in pairs.calc_distance_matrix(df).collect():
        m = met(r.first, r.second)
        assert r.distance == (None if m is None else r.first + r.second - 2.0 * m)
    assert {r.id: r.mrca_id for r in pairs.calc_mrca_id_vector(df, target_id=20).collect()} == {i: met(i, 20) if met(i, 20) is not None else -1 for i, _ in edges}
    with pytest.raises(ValueError):
        pairs.calc_mrca_id_vector(df, target_id=10_000)
    with pytest.raises(ValueError):
        pairs.find_mrca_id(df, [])


def test_triplets_quartets_and_isomorphism(spark):
    read = lambda text: newick.from_newick(text, spark)
    a, b, c = read("((a,b),(c,d));"), read("((c,d),(b,a));"), read("((a,c),(b,d));")
    one = lambda df: df.first()[0]
    assert one(pairs.calc_triplet_distance(a, b)) == 0 and one(pairs.calc_triplet_distance(a, c)) == 1
    assert one(pairs.calc_quartet_distance(a, b)) == 0 and one(pairs.calc_quartet_distance(a, c)) == 1
    assert one(pairs.test_leaves_isomorphic(a, b, "taxon_label")) and not one(pairs.test_leaves_isomorphic(a, c, "taxon_label"))
    assert one(pairs.test_leaves_isomorphic(a, read("(((a),b),(c,(d)));"), "taxon_label"))
    labels = {r.taxon_label: r.id for r in a.filter("taxon_label <> ''").collect()}
    assert pairs.categorize_triplet(a, [labels[x] for x in "abc"]) == 2
    assert pairs.categorize_triplet(read("(a,b,c);"), [1, 2, 3]) == -1
    estimate, (low, high, n) = pairs.estimate_triplet_distance(a, c, "taxon_label", confidence=0.9, precision=0.05, detail=True, batch=300)
    assert estimate == 1 and low <= 1 <= high + 1e-9 and n >= 250
    star = read("(a,b,c,d);")
    about = lambda x, y, strict: pairs.estimate_triplet_distance(x, y, "taxon_label", confidence=0.9, precision=0.05, strict=strict, batch=300)
    assert (about(a, star, True), about(a, star, (True, False)), about(star, a, (True, False)), about(star, a, False)) == (1, 0, 1, 0)
    assert pairs.estimate_triplet_distance(read("(a,b);"), read("(b,a);"), "taxon_label", detail=True) == (0.0, (0.0, 0.0, 0))


def test_newick_reading(spark):
    rows = lambda text, **o: [(r.id, r.ancestor_id, r.taxon_label, r.branch_length) for r in newick.from_newick(text, spark, **o).orderBy("id").collect()]
    assert rows("") == []
    assert rows("root;") == [(0, 0, "root", None)]
    assert rows("((child)parent,aunt)root;") == [(0, 0, "root", None), (1, 0, "parent", None), (2, 1, "child", None), (3, 0, "aunt", None)]
    assert rows("(a:1.5,'b, (c)':-2e-3,'it''s':3)r:0;") == [(0, 0, "r", 0.0), (1, 0, "a", 1.5), (2, 0, "b, (c)", -0.002), (3, 0, "it's", 3.0)]
    assert rows("(a[x[y]],b)[note];") == [(0, 0, "", None), (1, 0, "a", None), (2, 0, "b", None)]
    assert rows("(a_b,c);", replace_unquoted={"_": " "})[1][2] == "a b"
    assert rows("(a,b);(c);", allow_forest=True) == [(0, 0, "", None), (1, 0, "a", None), (2, 0, "b", None), (3, 3, "", None), (4, 3, "c", None)]
    for bad in ("(a,b;", "a,b;", "(a));"):
        with pytest.raises(newick.NewickError):
            newick.parse_newick(bad)
    with pytest.raises(Exception, match="several trees"):
        rows("a;b;", allow_forest=False)


@pytest.mark.parametrize("name", ["one", "chain", "star", "random", "forest", "sparse"])
def test_newick_round_trip(spark, name):
    edges = shapes()[name]
    df = table(spark, edges, label=lambda i: f"n {i}'s", origin_time=lambda i: i / 4)
    text = newick.as_newick(df, taxon_label="label").first().newick
    back = newick.from_newick(text, spark, allow_forest=True).collect()
    label = {r.id: r.taxon_label for r in back}
    assert {(r.taxon_label, label[r.ancestor_id]) for r in back} == {(f"n {i}'s", f"n {a}'s") for i, a in edges}
    assert {r.taxon_label: r.branch_length for r in back} == {f"n {i}'s": (i - a) / 4 for i, a in edges}


def test_newick_of_nothing(spark):
    assert newick.as_newick(table(spark, [])).first().newick == ";"


def test_sources(spark):
    assert trees.make_empty(spark).count() == 0 and trees.make_balanced_bifurcating(spark, 0).count() == 0
    assert [trees.make_star(spark, n).count() for n in (0, 1, 2)] == [0, 1, 3]
    assert [trees.make_comb(spark, n).count() for n in (0, 1, 4)] == [0, 1, 7]
    for make in (trees.make_edge_split, trees.make_leaf_split):
        for n in (1, 2, 9):
            df = make(spark, n, seed=n)
            assert df.count() == 2 * n - 1 and counts.count_leaf_nodes(df).first()[0] == n
            assert checks.is_strictly_bifurcating(df).first()[0] and [r.id for r in checks.find_root_ids(df).collect()] == [0]
    both = trees.aggregate_phylogenies([trees.make_star(spark, 3), trees.make_comb(spark, 2)])
    assert {r.id for r in both.collect()} == set(range(7)) and counts.count_root_nodes(both.drop("tree_id")).first()[0] == 2


def test_spop(spark):
    text = "#filetype genotype_data\n#format id src parents update_born depth cells\n# note\n2 div:int (none) -1 0\n7 div:int 2 30 1 5,6\n9 div:int 2,7 40 2 1\n"
    rows = {r.id: r for r in spop.from_avida_spop(spark, text=text).collect()}
    assert {i: r.ancestor_list for i, r in rows.items()} == {2: "[none]", 7: "[2]", 9: "[2,7]"}
    assert (rows[2].origin_time, rows[7].origin_time, rows[2].cells) == (-1, 30, "NONE")
    for bad in ("1 2 3", "#format id parents update_born\n1 (none) 0\n1 (none) 0"):
        with pytest.raises(ValueError):
            spop.from_avida_spop(spark, text=bad)


def test_sampling(spark):
    edges = shapes()["random"]
    df = table(spark, edges, origin_time=float)
    tips = leaves(edges)
    for mark in (sampling.mark_sample_tips_uniform, sampling.mark_sample_tips_canopy, sampling.mark_sample_tips_lineage):
        for n in (0, 1, 5, 1000):
            got = {r.id for r in mark(df, n).collect() if r.sampled}
            assert got <= tips and len(got) == min(n, len(tips))
    for seed in range(4):
        got = {r.id for r in sampling.mark_sample_tips_clade(df, 8, seed=seed).collect() if r.sampled}
        assert any(got == tips & set(clade(edges, i)) for i, _ in edges) and 1 <= len(got) <= 8
    assert {r.id for r in sampling.mark_sample_tips_clade(df, 1000).collect() if r.sampled} == tips
    cut = [(r.id, r.ancestor_id) for r in sampling.downsample_tips_uniform(df, 6, seed=2).collect()]
    assert len(leaves(cut)) == 6 and leaves(cut) <= tips
    with pytest.raises(ValueError):
        sampling.mark_sample_tips_lineage_stratified(df, 5, n_tips_per_stratum=2)
    assert sum(r.sampled for r in sampling.mark_sample_tips_lineage_stratified(df, 6, n_tips_per_stratum=2).collect()) == 6


def fitch(edges, absent, present):
    """The same screen, node by node."""
    state = {i: absent(i) + 2 * present(i) for i, _ in edges}
    union = dict(state)
    for _ in range(len(edges) + 1):
        new = {}
        for i in state:
            s = [state[c] for c in children(edges, i)]
            for x in s:
                union[i] |= x
            zeros, ones = sum(x & 1 for x in s), sum(x >> 1 for x in s)
            common = 3
            for x in s:
                common &= x
            new[i] = state[i] or ((common or union[i]) if zeros == ones else 1 if zeros > ones else 2)
        state = new
    up_ = dict(edges)
    for i in sorted(state, key=lambda i: len(lineage(edges, i))):
        if up_[i] == i:
            state[i] = 1 if state[i] == 3 else state[i]
        else:
            state[i] = state[i] & state[up_[i]] or state[i]
    return {i: state[i] == 2 and state[up_[i]] != 2 for i in state}


def test_traits(spark):
    edges = shapes()["balanced"]
    df = table(spark, edges, v=lambda i: i * 13 % 10)
    yes, no = F.col("v") < 4, F.col("v") > 5
    has, lacks = (lambda i: i * 13 % 10 < 4), (lambda i: i * 13 % 10 > 5)
    got = {r.id: r.trait_defined_fitch for r in traits.screen_trait_defined_clades_fitch(df, mask_trait_absent=no, mask_trait_present=yes).collect()}
    assert got == fitch(edges, lacks, has)
    only = {r.id: r.trait_defined_fitch for r in traits.screen_trait_defined_clades_fitch(table(spark, shapes()["random"], v=lambda i: i * 13 % 10), mask_trait_absent=no, mask_trait_present=yes).collect()}
    assert only == fitch(shapes()["random"], lacks, has)
    n = lambda i, f: sum(map(f, clade(edges, i)))
    for r in traits.screen_trait_defined_clades_fisher(df, mask_trait_absent=no, mask_trait_present=yes).collect():
        up_ = dict(edges)[r.id]
        s = r.id if up_ == r.id else next(c for c in children(edges, up_) if c != r.id)
        a1, a0, b1, b0 = n(r.id, has), n(r.id, lacks), n(s, has), n(s, lacks)
        total = math.comb(a1 + a0 + b1 + b0, a1 + a0)
        want = sum(math.comb(a1 + b1, x) * math.comb(a0 + b0, a1 + a0 - x) for x in range(a1, min(a1 + b1, a1 + a0) + 1)) / total if a1 else 1.0
        assert math.isclose(r.trait_defined_fisher, want, rel_tol=1e-9)
    with pytest.raises(ValueError, match="both"):
        traits.calc_clade_trait_count(traits.calc_clade_trait_frequency(df, mask_trait_absent=yes, mask_trait_present=yes), trait_mask=yes)


def test_growth(spark):
    edges = shapes()["balanced"]
    df = table(spark, edges, origin_time=lambda i: math.sqrt(i) + i % 3)
    time = lambda i: math.sqrt(i) + i % 3
    rows = {r.id: r.clade_logistic_growth_children for r in traits.mark_clade_logistic_growth_children(df).collect()}
    for i, _ in edges:
        if i in leaves(edges):
            assert math.isnan(rows[i])
            continue
        left, right = children(edges, i)
        tips = [(time(j), j in clade(edges, right)) for j in leaves(edges) & set(clade(edges, i))]
        w = rows[i]
        gradient = w + sum(x * (1 / (1 + math.exp(-w * x)) - y) for x, y in tips)
        assert abs(gradient) < 1e-6  # the penalised likelihood's maximum
    sister = {r.id: r.clade_logistic_growth_sister for r in traits.mark_clade_logistic_growth_sister(df).collect()}
    assert math.isnan(sister[0]) and sister[1] == -rows[0] and sister[2] == rows[0]
    fblr = {r.id: r.clade_fblr_growth_children for r in traits.mark_clade_fblr_growth_children(df, work_mask=F.col("id") == 0).collect()}
    assert not math.isnan(fblr[0]) and math.isnan(fblr[1]) and fblr[0] * rows[0] > 0


def test_ot_mrca_and_lookback(spark):
    edges = shapes()["random"]
    df = table(spark, edges, origin_time=lambda i: float(i // 4))
    met = lambda ids: next(i for i in lineage(edges, ids[0]) if all(i in lineage(edges, j) for j in ids))
    for r in traits.mark_ot_mrca(df).collect():
        m = met([i for i, _ in edges if i // 4 >= r.id // 4])
        assert (r.ot_mrca_id, r.ot_mrca_time_of, r.ot_mrca_time_since) == (m, m // 4, r.id // 4 - m // 4)
    for r in traits.calc_clade_lookback_origin_time_delta(df, 3.0).collect():
        older = [j for j in lineage(edges, r.id) if j // 4 <= r.id // 4 - 3]
        assert r.lookback_id == (older[0] if older else 0)


def test_validator(spark):
    good = spark.createDataFrame([(0, "[none]", 0), (1, "[0]", 0), (2, "[0]", 0)], "id long, ancestor_list string, ancestor_id long")
    sexual = spark.createDataFrame([(0, "[none]"), (1, "[]"), (2, "[0,1]"), (3, "[0, 1]")], "id long, ancestor_list string")
    assert checks.validate(good) and checks.validate(sexual) and checks.validate(good.limit(0))
    bad = {
        "malformed": [(0, "[non]", 0)], "malformed ": [(0, "none", 0)], "malformed  ": [(0, None, 0)], "repeat": [(0, "[none]", 0), (0, "[none]", 0)],
        "differs": [(0, "[none]", 0), (1, "[0]", 1)], "negative": [(-1, "[none]", -1)], "no id": [(0, "[none]", 0), (1, "[7]", 7)],
    }
    for why, rows in bad.items():
        with pytest.warns(UserWarning, match=why.strip()):
            assert not checks.validate(spark.createDataFrame(rows, good.schema))
    assert not checks.validate(good.drop("id"), diagnose=False) and not checks.validate(good.drop("ancestor_list"), diagnose=False)


def test_representation(spark):
    df = table(spark, shapes()["sparse"], origin_time=lambda i: float(i % 5))
    edges = shapes()["sparse"]
    work = representation.to_working_format(df).drop("pos")
    assert checks.is_working_format(work).first()[0] and not checks.is_working_format(df).first()[0]
    assert counts.count_leaf_nodes(work).first()[0] == len(leaves(edges))
    assert checks.is_topologically_sorted(representation.topological_sort(df)).first()[0]
    assert checks.is_chronologically_sorted(representation.chronological_sort(df)).first()[0]
    pedigree = spark.createDataFrame([(4, "[2,3]", 0), (2, "[0,1]", 1), (0, "[none]", 2), (3, "[0,1]", 3), (1, "[none]", 4)], "id long, ancestor_list string, pos long")
    order = {r.id: r.pos for r in representation.topological_sort(pedigree).collect()}
    assert max(order[0], order[1]) < min(order[2], order[3]) and order[4] == 4
    assert {r.ancestor_list for r in representation.assign_contiguous_ids(pedigree).collect()} == {"[none]", "[2,4]", "[1,3]"}
    assert representation.assign_root_ancestor_token(pedigree, "None").filter("ancestor_list = '[None]'").count() == 2
    assert "ancestor_id" not in representation.try_add_ancestor_id_col(pedigree).columns
    spellings = spark.createDataFrame([("[none]",), ("[None]",), ("[]",), ("[12]",), ("[1,2]",)], "l string")
    assert [r[0] for r in spellings.select(columns.parse_ancestor_id(F.col("l"))).collect()] == [None, None, None, 12, None]
    assert [r[0] for r in spellings.select(columns.parse_ancestor_ids(F.col("l"))).collect()] == [[], [], [], [12], [1, 2]]
    assert representation.pipe_unary_ops(df, "mark_leaves", lambda x: x.drop("pos")).columns == ["id", "ancestor_id", "origin_time", "is_leaf"]


def test_division_like_ieee(spark):
    row = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double").select(columns.ieee_div(F.col("a"), F.col("b"))).collect()
    assert row[0][0] == math.inf and row[1][0] == -math.inf and math.isnan(row[2][0]) and row[3][0] == 2


def test_deep_chain_needs_few_rounds(spark):
    n = 5_000
    df = spark.range(n).select("id", F.greatest(F.col("id") - 1, F.lit(0)).alias("ancestor_id"))
    for engine in ("kernel", "doubling"):
        out = down(df, {"d": (F.when(F.col("id") > 0, 1).otherwise(0), "sum")}, engine=engine)
        assert out.filter("d = id").count() == n


def test_matrices_of_many_trees(spark, monkeypatch):
    """All pairs within each tree; trees together may have more nodes than one tree whose pairs are listed."""
    forest = {t: edges for t, edges in enumerate((shapes()["random"], shapes()["balanced"], shapes()["sparse"]))}
    df = spark.createDataFrame([(t, i, a, float(3 * i)) for t, edges in forest.items() for i, a in edges], "tree_id long, id long, ancestor_id long, origin_time double")
    monkeypatch.setattr(pairs, "MOST_PAIRED", 80)  # of 131 nodes, 60 in the largest tree
    want = {}
    for t, edges in forest.items():
        for i, _ in edges:
            for j, _ in edges:
                want[t, i, j] = next(x for x in lineage(edges, i) if x in lineage(edges, j))
    got = pairs.calc_mrca_id_matrix(df).collect()
    assert len(got) == len(want) and {(r.tree_id, r.first, r.second): r.mrca_id for r in got} == want
    far = pairs.calc_distance_matrix(df).collect()
    assert {(r.tree_id, r.first, r.second): r.distance for r in far} == {(t, i, j): 3.0 * (i + j - 2 * m) for (t, i, j), m in want.items()}
    monkeypatch.setattr(pairs, "MOST_PAIRED", 70)
    with pytest.raises(ValueError, match="131 nodes"):
        pairs.calc_mrca_id_matrix(df)
