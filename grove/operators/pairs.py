"""Common ancestors, distances, and comparison of trees.

A common ancestor is found by binary lifting over frames of pairs: both ends
climb to one depth, then together by falling powers of two while they differ,
log2(depth) joins, whatever the number of pairs.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions.columns import is_root
from grove.operators.marks import mark_leaves, mark_node_depth
from grove.plans.folds import down, euler, keys, up
from grove.plans.numbering import numbered
from grove.plans.scratch import cut


def lifted(df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes with depth, and the ancestors 1, 2, 4, ... steps up, no higher than the root."""
    k = keys(df)
    nodes, _ = cut(mark_node_depth(df.select(*k, "id", "ancestor_id"), mark_as="depth"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    hops, hop = [], nodes.select(*k, "id", F.col("ancestor_id").alias("up"))
    for _ in range(max(1, deepest.bit_length())):
        hops.append(hop)
        hop, _ = cut(hop.join(hop.select(*k, F.col("id").alias("up"), F.col("up").alias("further")), [*k, "up"]).select(*k, "id", F.col("further").alias("up")))
    return nodes, hops


def find_mrca_ids(df: DataFrame, pairs: DataFrame, *, mark_as: str = "mrca_id") -> DataFrame:
    """The common ancestor of ``first`` and ``second`` of each pair; null across roots or for unknown ids."""
    k = keys(df)
    nodes, hops = lifted(df)
    at = lambda side: nodes.select(*k, F.col("id").alias(side), F.col("depth").alias(f"_d{side}"))
    state = pairs.join(at("first"), [*k, "first"], "left").join(at("second"), [*k, "second"], "left")
    state = state.withColumns({"_x": F.when(F.col("_dfirst") >= F.col("_dsecond"), F.col("first")).otherwise(F.col("second"))})
    state = state.withColumns(
        {"_y": F.when(F.col("_dfirst") >= F.col("_dsecond"), F.col("second")).otherwise(F.col("first")), "_gap": F.abs(F.col("_dfirst") - F.col("_dsecond"))}
    )

    def climb(state: DataFrame, hop: DataFrame, names: list[str], when: Column) -> DataFrame:
        for n in names:
            state = state.join(hop.select(*k, F.col("id").alias(n), F.col("up").alias(f"_up{n}")), [*k, n], "left")
        move = state.withColumn("_go", when)
        return move.withColumns({n: F.when(F.col("_go"), F.col(f"_up{n}")).otherwise(F.col(n)) for n in names}).drop("_go", *(f"_up{n}" for n in names))

    for i, hop in reversed(list(enumerate(hops))):
        state = climb(state, hop, ["_x"], F.expr(f"(_gap & {1 << i}) <> 0"))
    state, _ = cut(state)
    for hop in reversed(hops):
        state = climb(state, hop, ["_x", "_y"], F.col("_up_x") != F.col("_up_y"))
    last = hops[0].select(*k, F.col("id").alias("_x"), F.col("up").alias("_upx"))
    over = hops[0].select(*k, F.col("id").alias("_y"), F.col("up").alias("_upy"))
    state = state.join(last, [*k, "_x"], "left").join(over, [*k, "_y"], "left")
    found = F.when(F.col("_x") == F.col("_y"), F.col("_x")).when(F.col("_upx") == F.col("_upy"), F.col("_upx"))
    return state.withColumn(mark_as, found).select(*(c for c in pairs.columns if c != mark_as), mark_as)


def _lowest_above(walked: DataFrame, low: int, high: int) -> DataFrame:
    """One row: the lowest node whose clade holds two places of the walk; null where there is none."""
    over = (F.col("pre") <= low) & (F.col("pre") + F.col("size") > high)
    return walked.filter(over).agg(F.max_by("id", "depth").alias("mrca_id"), F.max("depth").alias("depth"))


def _lowest_of(df: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: the node of the least clade that holds all ids of ``asked``; null if one of them is none of the tree's."""
    ids = asked.select("id").distinct()
    marked = df.select("id", "ancestor_id").join(ids.withColumn("_asked", F.lit(1)), "id", "left")
    held = up(marked, {"_held": ("_asked", "sum"), "_size": (F.lit(1), "sum")})
    return held.filter(F.col("_held") == ids.count()).agg(F.min_by("id", "_size").alias("mrca_id"))


def _walked(df: DataFrame, *more: str) -> DataFrame:
    return cut(euler(df.select(*dict.fromkeys(["id", "ancestor_id", *more]))))[0]


def _ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], "id long")


def find_pair_mrca_id(df: DataFrame, first: int, second: int) -> DataFrame:
    """One row; null in different trees."""
    return _lowest_of(df, _ids(df.sparkSession, [first, second]))


def find_mrca_id(df: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """The common ancestor of a set. ValueError for an empty set."""
    asked = ids if isinstance(ids, DataFrame) else _ids(df.sparkSession, ids)
    known, _ = cut(asked.select("id").join(df.select("id"), "id", "left_semi"))
    if not known.limit(1).count():
        raise ValueError("no ids to find a common ancestor of")
    return _lowest_of(df, known)


def find_pair_distance(df: DataFrame, first: int, second: int, *, criterion: str = "origin_time") -> DataFrame:
    """One row: c(first) - c(mrca) + c(second) - c(mrca); null in different trees."""
    met = _lowest_of(df, _ids(df.sparkSession, [first, second]))
    value = lambda name: F.max(F.when(F.col("id") == name, F.col(criterion).cast("double")))
    values = df.crossJoin(F.broadcast(met)).agg(value(first).alias("a"), value(second).alias("b"), value(F.col("mrca_id")).alias("m"))  # one row
    return values.select((F.col("a") - F.col("m") + (F.col("b") - F.col("m"))).alias("distance"))


def distances(df: DataFrame, pairs: DataFrame, *, criterion: str = "origin_time") -> DataFrame:
    """(c(first) - c(mrca)) + (c(second) - c(mrca)) of each pair; null across roots."""
    k = keys(df)
    out = find_mrca_ids(df, pairs, mark_as="_m")
    for side in ("first", "second", "_m"):
        out = out.join(df.select(*k, F.col("id").alias(side), F.col(criterion).cast("double").alias(f"_c{side}")), [*k, side], "left")
    return out.select(*pairs.columns, (F.col("_cfirst") - F.col("_c_m") + (F.col("_csecond") - F.col("_c_m"))).alias("distance"))


def calc_mrca_id_vector(df: DataFrame, *, target_id: int) -> DataFrame:
    """(id, mrca_id) of every node with the target; -1 across roots. The lowest node above both."""
    if not df.filter(F.col("id") == target_id).limit(1).count():
        raise ValueError(f"no node {target_id}")
    above = up(df.select("id", "ancestor_id"), {"_over": (F.when(F.col("id") == target_id, 1).otherwise(0), "max")})
    marked = above.select("id", "ancestor_id", F.when(F.col("_over") > 0, F.col("id")).alias("_on"))
    return down(marked, {"_m": ("_on", "last")}).select("id", F.coalesce("_m", F.lit(-1)).alias("mrca_id"))


#: Nodes of a table without tree_id whose pairs may be listed; with one, the pairs within trees may be as many.
MOST_PAIRED = 20_000


def _all_pairs(df: DataFrame) -> DataFrame:
    k = keys(df)
    each = df.groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, listed = each.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()
    if listed > MOST_PAIRED**2:
        raise ValueError(f"{n:.0f} nodes have too many pairs to list; ask for the pairs you need")
    first, second = df.select(*k, F.col("id").alias("first")), df.select(*k, F.col("id").alias("second"))
    return first.join(second, k) if k else first.crossJoin(second)  # the result itself is all pairs


def calc_mrca_id_matrix(df: DataFrame) -> DataFrame:
    """(first, second, mrca_id) of all pairs; -1 across roots."""
    return find_mrca_ids(df, _all_pairs(df)).withColumn("mrca_id", F.coalesce("mrca_id", F.lit(-1)))


def calc_distance_matrix(df: DataFrame, *, criterion: str = "origin_time") -> DataFrame:
    """(first, second, distance) of all pairs; null across roots."""
    return distances(df, _all_pairs(df), criterion=criterion)


# ---------------------------------------------------------------- triplets and quartets


def outgroup(a: Column, b: Column, c: Column) -> Column:
    """Which of three leaves stands apart, from the depths of the common ancestors of (1,2), (0,2), (0,1); -1 for none."""
    return F.when((a > b) & (a > c), 0).when((b > a) & (b > c), 1).when((c > a) & (c > b), 2).otherwise(-1)


def _pair_depths(df: DataFrame, label: str) -> DataFrame:
    """(x, y, depth) for labels x < y of leaves: the depth of their common ancestor."""
    leaves = mark_leaves(df, mark_as="_leaf").filter("_leaf").select("id", F.col(label).alias("_label"))
    n = leaves.count()
    if n > MOST_PAIRED // 40:
        raise ValueError(f"{n} leaves are too many to list their quartets")
    a, b = leaves.select(F.col("id").alias("first"), F.col("_label").alias("x")), leaves.select(F.col("id").alias("second"), F.col("_label").alias("y"))
    pairs = a.join(b, F.col("x") < F.col("y"))
    met = find_mrca_ids(df, pairs, mark_as="_m")
    depth = mark_node_depth(df.select("id", "ancestor_id"), mark_as="depth").select(F.col("id").alias("_m"), "depth")
    return cut(met.join(depth, "_m").select("x", "y", "depth"))[0]


def _closure(df: DataFrame, label: str) -> DataFrame:
    """(label, node) for each leaf and each of its ancestors, itself included, by doubling."""
    nodes, hops = lifted(df)
    leaves = mark_leaves(df, mark_as="_leaf").filter("_leaf").select("id", F.col(label).alias("label"))
    out = leaves.join(nodes.select("id", "depth"), "id").withColumnRenamed("id", "node")
    for i, hop in enumerate(hops):
        step = hop.select(F.col("id").alias("node"), "up")
        above = out.filter(F.col("depth") >= 1 << i).join(step, "node").select("up", "label", (F.col("depth") - (1 << i)).alias("depth"))
        out, _ = cut(out.select("node", "label", "depth").unionByName(above.withColumnRenamed("up", "node")))
    return out.select("label", "node")


def calc_triplet_distance(ref: DataFrame, cmp: DataFrame, taxon_label_key: str = "taxon_label") -> DataFrame:
    """Share of leaf triplets whose outgroup differs. For equal sets of labels, one root each.

    From how many leaves the clades of a node of one tree and a node of the
    other share, and their parents' clades: no triplet is listed. A triplet xy|z
    is resolved below one node only, the child, holding x and y, of the three's
    common ancestor.
    """
    sides, resolved = [], []
    for df, node, up in ((ref, "a", "u"), (cmp, "b", "v")):
        closure = _closure(df, taxon_label_key).withColumnRenamed("node", node)
        parent = df.filter(~is_root()).select(F.col("id").alias(node), F.col("ancestor_id").alias(up))
        size = cut(closure.groupBy(node).agg(F.count(F.lit(1)).cast("double").alias("n")))[0]
        below = size.join(parent, node).join(size.select(F.col(node).alias(up), F.col("n").alias("_over")), up)
        resolved.append(below.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2 * (F.col("_over") - F.col("n"))), F.lit(0.0))).first()[0])
        sides.append((closure, parent, size.agg(F.max("n")).first()[0] or 0.0))
    (left, over_a, n), (right, over_b, _) = sides
    shared = cut(left.join(right, "label").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")))[0]
    both = shared.join(over_a, "a").join(over_b, "b")
    both = both.join(shared.select("a", F.col("b").alias("v"), F.col("n").alias("av")), ["a", "v"])
    both = both.join(shared.select(F.col("a").alias("u"), "b", F.col("n").alias("ub")), ["u", "b"])
    both = both.join(shared.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("n").alias("uv")), ["u", "v"])
    c = F.col
    agree = c("n") * (c("n") - 1) / 2 * (c("uv") - c("av") - c("ub") + c("n"))
    against = c("n") * (c("av") - c("n")) * (c("ub") - c("n"))
    total = n * (n - 1) * (n - 2) / 6
    wrong = F.lit(resolved[0] + resolved[1]) - F.coalesce(F.sum(2 * agree + against), F.lit(0.0))
    return both.agg((wrong / F.lit(total) if total else F.lit(0.0)).alias("distance"))


def _quartets(df: DataFrame, label: str, mark: str) -> DataFrame:
    """The split of each four leaves, by the least of three sums of distances; -1 for a star."""
    depths = _pair_depths(df, label)
    own = mark_node_depth(df.select("id", "ancestor_id", F.col(label).alias("l")), mark_as="d").select("l", "d")
    far = depths.join(own.select(F.col("l").alias("x"), F.col("d").alias("_dx")), "x").join(own.select(F.col("l").alias("y"), F.col("d").alias("_dy")), "y")
    far, _ = cut(far.select("x", "y", (F.col("_dx") + F.col("_dy") - 2 * F.col("depth")).alias("far")))
    d = lambda x, y: far.select(F.col("x").alias(x), F.col("y").alias(y), F.col("far").alias(x + y))
    rows = d("i", "j").join(d("k", "l"), F.col("j") < F.col("k"))
    for x, y in (("i", "k"), ("j", "l"), ("i", "l"), ("j", "k")):
        rows = rows.join(d(x, y), [x, y])
    p, q, r = F.col("ij") + F.col("kl"), F.col("ik") + F.col("jl"), F.col("il") + F.col("jk")
    return rows.select("i", "j", "k", "l", F.when((p < q) & (p < r), 0).when((q < p) & (q < r), 1).when((r < p) & (r < q), 2).otherwise(-1).alias(mark))


def calc_quartet_distance(ref: DataFrame, cmp: DataFrame, taxon_label_key: str = "taxon_label") -> DataFrame:
    """Share of leaf quartets whose unrooted split differs."""
    a, b = _quartets(ref, taxon_label_key, "_x"), _quartets(cmp, taxon_label_key, "_y")
    return a.join(b, ["i", "j", "k", "l"]).agg(F.coalesce(F.avg(F.when(F.col("_x") != F.col("_y"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("distance"))


def categorize_triplet(df: DataFrame, triplet_ids: list[int]) -> int:
    """Index of the outgroup among three ids, -1 for a polytomy."""
    walked = _walked(df)
    at = {r.id: r.pre for r in walked.filter(F.col("id").isin(list(triplet_ids))).select("id", "pre").collect()}  # three rows
    places = [at[i] for i in triplet_ids]
    found = {}
    for n in range(3):
        low, high = sorted(places[:n] + places[n + 1 :])
        found[n] = _lowest_above(walked, low, high).first().depth
    if None in found.values():
        raise ValueError("the ids are of several trees")
    best = max(found.values())
    return next(n for n, d in found.items() if d == best) if list(found.values()).count(best) == 1 else -1


def sample_triplet_comparisons(first: DataFrame, second: DataFrame, taxon_label_key: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` random triplets of labels with their outgroups in both trees and whether they match, strictly or but for polytomies."""
    spark = first.sparkSession
    leaves = mark_leaves(first, mark_as="_leaf").filter("_leaf").select(F.col(taxon_label_key).alias("label"))
    total = leaves.count()
    if total < 3:
        raise ValueError("fewer than three leaves")
    numbers = cut(numbered(leaves, ["label"], "_n"))[0]
    draw = spark.range(4 * n).select("id", *(F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(total)).alias(f"_{i}") for i in range(3)))
    draw = draw.filter("_0 <> _1 and _0 <> _2 and _1 <> _2").orderBy("id").limit(n)
    for i in range(3):
        draw = draw.join(numbers.select(F.col("_n").alias(f"_{i}"), F.col("label").alias(f"label_{i}")), f"_{i}")
    out = cut(draw.select("id", "label_0", "label_1", "label_2"))[0]
    for df, name in ((first, "first"), (second, "second")):
        tips = mark_leaves(df, mark_as="_leaf").filter("_leaf").select(F.col("id").alias("node"), F.col(taxon_label_key).alias("label"))
        long = out.select("id", F.explode(F.array(*(F.struct(F.lit(3 - x - y).alias("k"), F.col(f"label_{x}").alias("a"), F.col(f"label_{y}").alias("b")) for x, y in itertools.combinations(range(3), 2)))).alias("p")).select("id", "p.*")
        pairs = long.join(tips.select(F.col("label").alias("a"), F.col("node").alias("first")), "a").join(tips.select(F.col("label").alias("b"), F.col("node").alias("second")), "b")
        met = find_mrca_ids(df, pairs.select("id", "k", "first", "second"), mark_as="_m")
        depth = mark_node_depth(df.select("id", "ancestor_id"), mark_as="depth").select(F.col("id").alias("_m"), "depth")
        wide = met.join(depth, "_m").groupBy("id").pivot("k", [0, 1, 2]).agg(F.first("depth"))
        out = out.join(wide.select("id", outgroup(F.col("0"), F.col("1"), F.col("2")).alias(f"triplet_code_{name}")), "id")
    a, b = F.col("triplet_code_first"), F.col("triplet_code_second")
    return out.withColumns({"triplet_match_strict": a == b, "triplet_match_lax": (a == b) | (a == -1) | (b == -1)})


def wilson(successes: int, n: int, confidence: float) -> tuple[float, float]:
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    p, d = successes / n, 1 + z * z / n
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    middle = (p + z * z / (2 * n)) / d
    return middle - half, middle + half


def estimate_triplet_distance(
    first: DataFrame,
    second: DataFrame,
    taxon_label_key: str,
    confidence: float = 0.99,
    precision: float = 0.01,
    strict: bool | tuple[bool, bool] = True,
    detail: bool = False,
    batch: int = 10_000,
    seed: int = 0,
) -> float | tuple[float, tuple[float, float, int]]:
    """The share of differing triplets from samples, until its Wilson interval is narrow enough; with ``detail`` (estimate, (low, high, n)).

    A polytomy counts as a difference where ``strict`` says so, for both trees
    or for each; fewer than three leaves differ in nothing.
    """
    of_first, of_second = strict if isinstance(strict, tuple) else (strict, strict)
    if mark_leaves(first, mark_as="_leaf").filter("_leaf").limit(3).count() < 3:
        return (0.0, (0.0, 0.0, 0)) if detail else 0.0
    a, b = F.col("triplet_code_first"), F.col("triplet_code_second")
    differs = a != b
    if not of_first:
        differs = differs & (a != -1)
    if not of_second:
        differs = differs & (b != -1)
    wrong, n = 0, 0
    while True:
        sample = sample_triplet_comparisons(first, second, taxon_label_key, batch, seed + n)
        got = sample.agg(F.count_if(differs).alias("wrong"), F.count(F.lit(1)).alias("n")).first()
        wrong, n = wrong + got.wrong, n + got.n
        low, high = wilson(wrong, n, confidence)
        if high - low <= precision:
            return (wrong / n, (low, high, n)) if detail else wrong / n


def test_leaves_isomorphic(first: DataFrame, second: DataFrame, taxon_label: str) -> DataFrame:
    """Whether both have the same clades of labelled leaves, unifurcations aside: one row ``result``.

    A clade is the sum of two 64-bit hashes of its leaves' labels, so equal
    clades are equal rows and the trees are compared by two anti-joins.
    """

    def clades(df: DataFrame) -> DataFrame:
        k = keys(df)
        hashed = mark_leaves(df.select(*k, "id", "ancestor_id", taxon_label), mark_as="_leaf")
        part = lambda s: F.when(F.col("_leaf"), F.shiftright(F.xxhash64(F.col(taxon_label).cast("string"), F.lit(s)), 20)).otherwise(0)
        return up(hashed, {"_a": (part(1), "sum"), "_b": (part(2), "sum"), "_n": ("_leaf", "sum")}).select("_a", "_b", "_n").distinct()

    a, b = (cut(clades(x))[0] for x in (first, second))
    same = ["_a", "_b", "_n"]
    left = a.join(b, same, "left_anti").unionByName(b.join(a, same, "left_anti"))
    return left.agg((F.count(F.lit(1)) == 0).alias("result"))


test_leaves_isomorphic.__test__ = False
