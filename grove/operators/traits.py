"""Traits of clades: counts, frequencies, screens, growth, and common ancestors through time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.functions.columns import ieee_div, is_root
from grove.operators.marks import _bifurcating, _kept, mark_is_left_child, siblings, with_parent
from grove.plans.folds import LIMIT, euler, keys, largest_tree, run_kernel, up
from grove.plans.forest import Forest
from grove.plans.numbering import running
from grove.plans.scratch import cut


def _mask(mask: str | Column) -> Column:
    return F.coalesce(F.col(mask) if isinstance(mask, str) else mask, F.lit(False))


def calc_clade_trait_count(df: DataFrame, *, trait_mask: str | Column, mark_as: str = "trait_count") -> DataFrame:
    """Nodes of the clade that bear the trait, the node itself included."""
    return up(df, {mark_as: (F.when(_mask(trait_mask), 1).otherwise(0), "sum")})


def _counted(df: DataFrame, absent: str | Column, present: str | Column) -> DataFrame:
    if df.filter(_mask(absent) & _mask(present)).limit(1).count():
        raise ValueError("a node both has and lacks the trait")
    one = lambda m: F.when(_mask(m), 1).otherwise(0)
    return up(df, {"_absent": (one(absent), "sum"), "_present": (one(present), "sum")})


def calc_clade_trait_frequency(df: DataFrame, *, mask_trait_absent: str | Column, mask_trait_present: str | Column, mark_as: str = "trait_frequency") -> DataFrame:
    """Present over present and absent of the clade; NaN where neither is known."""
    out = _counted(df, mask_trait_absent, mask_trait_present)
    return _kept(df, out.withColumn(mark_as, ieee_div(F.col("_present"), F.col("_present") + F.col("_absent"))), mark_as)


def mask_monomorphic_clades(df: DataFrame, *, trait_mask: str | Column, trait_values: str | Column, mark_as: str = "is_monomorphic") -> DataFrame:
    """Clades whose known values are all equal; what isn't known does not count."""
    value = F.when(_mask(trait_mask), F.xxhash64((F.col(trait_values) if isinstance(trait_values, str) else trait_values).cast("string")))
    # Hashes stand for values; a null is the identity of either fold.
    out = up(df, {"_least": (value, "min"), "_most": (value, "max")})
    return _kept(df, out.withColumn(mark_as, F.col("_least") >= F.col("_most")), mark_as)


def _sister_value(df: DataFrame, name: str) -> Column:
    w = siblings(df)
    return F.when(is_root(), F.col(name)).otherwise(F.coalesce(F.lead(name).over(w), F.lag(name).over(w)))


@_bifurcating
def screen_trait_defined_clades_naive(
    df: DataFrame,
    *,
    mask_trait_absent: str | Column,
    mask_trait_present: str | Column,
    defining_mut_thresh: float = 0.75,
    defining_mut_sister_thresh: float = 0.75,
    mark_as: str = "trait_defined_naive",
) -> DataFrame:
    """Clades where the trait is frequent while it is rarer in the sister clade."""
    out = calc_clade_trait_frequency(df, mask_trait_absent=mask_trait_absent, mask_trait_present=mask_trait_present, mark_as="_f")
    sister = _sister_value(out, "_f")
    known = ~F.isnan("_f") & ~F.isnan(sister)
    return _kept(df, out.withColumn(mark_as, known & (F.col("_f") >= defining_mut_thresh) & (sister <= defining_mut_sister_thresh)), mark_as)


def fisher_greater(a1: int, a0: int, b1: int, b0: int, logs: np.ndarray | None = None) -> float:
    """P(X >= a1) for the hypergeometric count of a table's first cell; ``logs`` are logarithms of factorials."""
    n1, n, row = a1 + b1, a1 + a0 + b1 + b0, a1 + a0
    f = log_factorials(n) if logs is None else logs
    x = np.arange(a1, min(n1, row) + 1)
    if not len(x):
        return 0.0
    constant = f[n1] + f[n - n1] - f[n] + f[row] + f[n - row]
    return float(min(1.0, np.exp(constant - f[x] - f[n1 - x] - f[row - x] - f[n - n1 - row + x]).sum()))


def log_factorials(n: int) -> np.ndarray:
    return np.fromiter(map(math.lgamma, range(1, n + 2)), float, n + 1)


@_bifurcating
def screen_trait_defined_clades_fisher(df: DataFrame, *, mask_trait_absent: str | Column, mask_trait_present: str | Column, mark_as: str = "trait_defined_fisher") -> DataFrame:
    """One-tailed p-value that the trait is more frequent in the clade than in its sister; 1 where no node has it, a root against itself."""
    out = _counted(df, mask_trait_absent, mask_trait_present)
    out = out.withColumns({"_sp": _sister_value(out, "_present"), "_sa": _sister_value(out, "_absent")})
    kept = [c for c in df.columns if c != mark_as]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(mark_as, T.DoubleType())])

    def run(batches):
        for batch in batches:
            table = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_present", "_absent", "_sp", "_sa")], axis=1)
            distinct, at = np.unique(table, axis=0, return_inverse=True)
            logs = log_factorials(int(table.sum(axis=1).max(initial=0)))
            p = np.array([fisher_greater(*row, logs) if row[0] else 1.0 for row in distinct.tolist()], float)[at.ravel()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(p, pa.float64())], names=[*kept, mark_as])

    return out.mapInArrow(run, schema)


def _tree_kernel(df: DataFrame, made: dict[str, T.DataType], function) -> DataFrame:
    """Columns that a function of (forest, table) computes for whole trees, one task a tree."""
    kept = [c for c in df.columns if c not in made]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in made.items()])
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        forest = Forest(table["id"].combine_chunks().cast(pa.int64()).to_numpy(), table["ancestor_id"].combine_chunks().cast(pa.int64()).to_numpy())
        new = function(forest, table)
        return pa.table([pa.array(new[n]) if n in new else table[n] for n in names], names=names)

    return run_kernel(df, run, schema)


def screen_trait_defined_clades_fitch(df: DataFrame, *, mask_trait_absent: str | Column, mask_trait_present: str | Column, mark_as: str = "trait_defined_fitch") -> DataFrame:
    """Clades at whose root the trait was gained, by parsimony: states are sets, 1 absent and 2 present.

    Upward, in rounds, each node without a state takes the majority of the
    states that its children have by then; on a tie what all of them share,
    else all of theirs. Downward a node keeps what it shares with its parent,
    if anything; an ambiguous root lacks the trait.
    """
    if df.filter(_mask(mask_trait_absent) & _mask(mask_trait_present)).limit(1).count():
        raise ValueError("a node both has and lacks the trait")
    state = F.when(_mask(mask_trait_absent), 1).when(_mask(mask_trait_present), 2).otherwise(0)

    def run(forest: Forest, table: pa.Table) -> dict:
        state, parent = table["_state"].to_numpy().astype(np.int64), forest.parent
        below = np.flatnonzero(~forest.is_root)
        over, children = parent[below], forest.num_children
        union = state.copy()
        while forest.n and (state == 0).any():
            own = state[below]
            absent, present = (np.bincount(over, own >> bit & 1, forest.n) for bit in (0, 1))
            np.bitwise_or.at(union, over, own)
            common = 1 * (absent == children) + 2 * (present == children)
            tied = np.where(common == 0, union, common)
            major = np.where(absent == present, tied, np.where(absent > present, 1, 2))
            state = np.where(state == 0, major, state)
        for rows in forest.levels[:1]:
            state[rows] = np.where(state[rows] == 3, 1, state[rows])
        for rows in forest.levels[1:]:
            shared = state[rows] & state[parent[rows]]
            state[rows] = np.where(shared > 0, shared, state[rows])
        return {mark_as: (state == 2) & (state[parent] != 2)}

    out = _tree_kernel(df.drop(mark_as).withColumn("_state", state), {mark_as: T.BooleanType()}, run)
    return out.drop("_state")


# ---------------------------------------------------------------- growth


def _newton_logistic(x: np.ndarray, y: np.ndarray, intercept: bool) -> float:
    """Slope of a logistic regression with an L2 penalty of 1 (none on an intercept)."""
    w = b = 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(sign * (w * x + b), -700, 700)))
        g, h = w - (sign * x * p).sum(), 1 + (x * x * p * (1 - p)).sum()
        if intercept:
            gb, hb, c = -(sign * p).sum(), (p * (1 - p)).sum() + 1e-12, (x * p * (1 - p)).sum()
            d = h * hb - c * c
            step, step_b = (hb * g - c * gb) / d, (h * gb - c * g) / d
        else:
            step, step_b = g / h, 0.0
        w, b = w - step, b - step_b
        if abs(step) + abs(step_b) < 1e-12:
            break
    return float(w)


def logistic_slope(x: np.ndarray, y: np.ndarray, span: float) -> float:
    """``span`` is the range of times in the clade: next to none asks for an intercept."""
    return _newton_logistic(x, y, intercept=span < 1e-3)


def fblr_slope(x: np.ndarray, y: np.ndarray, span: float, gamma: float = 1e-3, epsilon: float = 1e-10, tolerance: float = 1e-3, most: int = 10) -> float:
    """Slope by reweighted least squares with the quadratic bound of the logistic loss and a shrinking penalty; 0 for equal times."""
    if span < 1e-6:
        return 0.0
    w = float((x * y).sum() / ((x * x).sum() + 1e-8))
    v = float((x * (y - 0.5)).mean())
    for turn in range(most + 1):
        o = x * w
        z = (np.logaddexp(0, o) - math.log(2) - 0.5 * o) / (o * o + epsilon)
        new = v / (2 * float((z * x * x).mean()) + gamma / (w * w + epsilon))
        change, w = abs(new - w), new
        if turn >= 2 and change <= tolerance:
            break
    return w


def _growth(df: DataFrame, mark_as: str, fit, work_mask: str | Column | None) -> DataFrame:
    """Slope of side (left 0, right 1) on the origin_time of a clade's leaves, for inner nodes; NaN elsewhere."""
    work = F.lit(True) if work_mask is None else _mask(work_mask)

    def run(forest: Forest, table: pa.Table) -> dict:
        n, parent = forest.n, forest.parent
        times, todo = table["origin_time"].to_numpy().astype(float), table["_work"].to_numpy(zero_copy_only=False)
        size = forest.up(np.ones(n, np.int64), "sum")
        # Walk numbers by hand: each clade is a slice of the walk.
        offsets, children = forest.children
        start, before = np.zeros(n, np.int64), np.cumsum(size[children]) - size[children] if len(children) else np.empty(0, np.int64)
        if len(children):
            first = before[np.minimum(offsets[parent[children]], len(children) - 1)]
            start[children] = 1 + before - first
        roots = np.flatnonzero(forest.is_root)
        start[roots] = np.cumsum(size[roots]) - size[roots]
        pre = forest.down(start, "sum")
        walk = np.empty(n, np.int64)
        walk[pre] = np.arange(n)
        leaf, out = forest.num_children[walk] == 0, np.full(n, np.nan)
        at = times[walk]
        for row in np.flatnonzero((forest.num_children == 2) & todo):
            a, b = pre[row] + 1, pre[row] + size[row]
            middle = pre[forest.children_of(row)[1]]
            rows = np.arange(a, b)[leaf[a:b]]
            out[row] = fit(at[rows], (rows >= middle).astype(float), float(np.ptp(at[a - 1 : b])))
        return {mark_as: out}

    return _tree_kernel(df.drop(mark_as).withColumn("_work", work), {mark_as: T.DoubleType()}, run).drop("_work")


@_bifurcating
def mark_clade_logistic_growth_children(df: DataFrame, *, mark_as: str = "clade_logistic_growth_children", work_mask=None) -> DataFrame:
    return _growth(df, mark_as, logistic_slope, work_mask)


@_bifurcating
def mark_clade_fblr_growth_children(df: DataFrame, *, mark_as: str = "clade_fblr_growth_children", work_mask=None) -> DataFrame:
    return _growth(df, mark_as, fblr_slope, work_mask)


def _of_sister(df: DataFrame, mark_as: str, marked: DataFrame) -> DataFrame:
    """The parent's slope, signed by side; NaN for a root."""
    out = mark_is_left_child(with_parent(marked, _slope="_g"), mark_as="_left", assume_valid=True)
    return _kept(df, out.withColumn(mark_as, F.when(is_root(), float("nan")).otherwise(F.col("_slope") * F.when(F.col("_left"), -1).otherwise(1))), mark_as)


@_bifurcating
def mark_clade_logistic_growth_sister(df: DataFrame, *, mark_as: str = "clade_logistic_growth_sister") -> DataFrame:
    return _of_sister(df, mark_as, mark_clade_logistic_growth_children(df.drop(mark_as), mark_as="_g", assume_valid=True))


@_bifurcating
def mark_clade_fblr_growth_sister(df: DataFrame, *, mark_as: str = "clade_fblr_growth_sister") -> DataFrame:
    return _of_sister(df, mark_as, mark_clade_fblr_growth_children(df.drop(mark_as), mark_as="_g", assume_valid=True))


# ---------------------------------------------------------------- lineages through time


def calc_clade_lookback_origin_time_delta(df: DataFrame, lookback_origin_time_delta: float, *, mark_as: str = "lookback_id", limit: int = LIMIT) -> DataFrame:
    """The nearest ancestor at least so much older, itself included for 0; the root if there is none.

    Climbs by powers of two past ancestors of which none is old enough: within
    one task a tree, or by joins where a tree has more than ``limit`` rows.
    """
    df = df.drop(mark_as)
    if largest_tree(df) > limit:
        return _lookback_by_joins(df, lookback_origin_time_delta, mark_as)

    def run(forest: Forest, table: pa.Table) -> dict:
        times = table["origin_time"].to_numpy().astype(float)
        # Each hop and the least time among the nodes that it passes, its end included.
        hops, least = [forest.parent], [times[forest.parent]]
        for _ in range(int(forest.depth.max(initial=0)).bit_length()):
            least.append(np.minimum(least[-1], least[-1][hops[-1]]))
            hops.append(hops[-1][hops[-1]])
        at, wanted = np.arange(forest.n), times - lookback_origin_time_delta
        open_ = times > wanted
        for hop, low in zip(reversed(hops), reversed(least), strict=True):
            at = np.where(open_ & (low[at] > wanted), hop[at], at)
        return {mark_as: forest.ids[np.where(open_, forest.parent[at], at)]}

    return _tree_kernel(df, {mark_as: T.LongType()}, run)


def _lookback_by_joins(df: DataFrame, delta: float, mark_as: str) -> DataFrame:
    k = keys(df)
    time = F.col("origin_time").cast("double")
    rows = df.select(*k, F.col("id").cast("long").alias("id"), F.col("ancestor_id").cast("long").alias("up"), time.alias("t"))
    hop, _ = cut(rows.join(rows.select(*k, F.col("id").alias("up"), F.col("t").alias("low")), [*k, "up"]).select(*k, "id", "up", "low"))
    hops = [hop]
    while True:
        over = hop.select(*k, F.col("id").alias("up"), F.col("up").alias("further"), F.col("low").alias("lower"))
        wide, _ = cut(hop.join(over, [*k, "up"]).select(*k, "id", F.col("further").alias("up"), F.least("low", "lower").alias("low"), (F.col("further") != F.col("up")).alias("moved")))
        if not wide.filter("moved").limit(1).count():
            break
        hop = wide.drop("moved")
        hops.append(hop)
    state = rows.select(*k, "id", F.col("id").alias("at"), (F.col("t") - delta).alias("wanted"), (F.col("t") > F.col("t") - delta).alias("open"))
    for i, hop in reversed(list(enumerate(hops))):
        step = hop.select(*k, F.col("id").alias("at"), F.col("up").alias("to"), "low")
        go = F.col("open") & (F.col("low") > F.col("wanted"))
        state = state.join(step, [*k, "at"]).select(*k, "id", F.when(go, F.col("to")).otherwise(F.col("at")).alias("at"), "wanted", "open")
        state, _ = cut(state) if i % 4 == 0 else (state, None)
    first = hops[0].select(*k, F.col("id").alias("at"), F.col("up").alias("to"))
    found = state.join(first, [*k, "at"]).select(*k, "id", F.when(F.col("open"), F.col("to")).otherwise(F.col("at")).alias(mark_as))
    return df.join(found, [*k, "id"]).select(*df.columns, mark_as)


def mark_ot_mrca(df: DataFrame, *, mark_as: str = "ot_mrca", limit: int = LIMIT) -> DataFrame:
    """For each origin_time the common ancestor of the lineages alive then: that of all nodes that are not older.

    It is the common ancestor of the first and the last of those nodes in the
    walk: within one task a tree, or by running extremes and lifting where a
    tree has more than ``limit`` rows.
    """
    if df.filter(is_root()).limit(2).count() > 1 and "tree_id" not in df.columns:
        raise NotImplementedError("several roots")
    names = [f"{mark_as}_id", f"{mark_as}_time_of", f"{mark_as}_time_since"]
    if largest_tree(df) > limit:
        return _ot_mrca_by_joins(df.drop(*names), names)

    def run(forest: Forest, table: pa.Table) -> dict:
        times = table["origin_time"].to_numpy().astype(float)
        pre = table["pre"].to_numpy()
        order = np.argsort(-times, kind="stable")
        last = np.searchsorted(-times[order], -times[order], "right") - 1  # rows of one time share what all of them leave
        row_at = np.argsort(pre)
        low, high = (row_at[f.accumulate(pre[order])[last]] for f in (np.minimum, np.maximum))
        hops = [forest.parent]
        for _ in range(int(forest.depth.max(initial=0)).bit_length()):
            hops.append(hops[-1][hops[-1]])
        x, y = np.where(forest.depth[low] >= forest.depth[high], (low, high), (high, low))
        gap = forest.depth[x] - forest.depth[y]
        for i, hop in enumerate(hops):
            x = np.where(gap >> i & 1, hop[x], x)
        for hop in reversed(hops):
            apart = hop[x] != hop[y]
            x, y = np.where(apart, hop[x], x), np.where(apart, hop[y], y)
        met = np.empty(forest.n, np.int64)
        met[order] = np.where(x == y, x, forest.parent[x])
        return dict(zip(names, (forest.ids[met], times[met], times - times[met]), strict=True))

    kinds = dict(zip(names, (T.LongType(), T.DoubleType(), T.DoubleType()), strict=True))
    walked = euler(df.drop(*names, "pre", "size", "depth", "post")).drop("size", "depth", "post")
    out = _tree_kernel(walked, kinds, run).drop("pre")
    kept = [c for c in ("pre", "size", "depth", "post") if c in df.columns]
    return out if not kept else out.join(df.select(*keys(df), "id", *kept), [*keys(df), "id"]).select(*(c for c in df.columns if c not in names), *names)


def _ot_mrca_by_joins(df: DataFrame, names: list[str]) -> DataFrame:
    from grove.operators.pairs import find_mrca_ids

    k = keys(df)
    walked, _ = cut(euler(df.select(*k, F.col("id").cast("long").alias("id"), "ancestor_id", F.col("origin_time").cast("double").alias("_t"))).select(*k, "id", "_t", "pre"))
    each = walked.groupBy(*k, "_t").agg(F.min("pre").alias("a"), F.max("pre").alias("b"))
    ends = running(each, [F.desc("_t")], {"_a": ("min", "a"), "_b": ("max", "b")}).select(*k, "_t", "_a", "_b")
    place = lambda at, name: walked.select(*k, F.col("pre").alias(at), F.col("id").alias(name))
    pairs, _ = cut(ends.join(place("_a", "first"), [*k, "_a"]).join(place("_b", "second"), [*k, "_b"]).select(*k, "_t", "first", "second"))
    met = find_mrca_ids(df.select(*k, F.col("id").cast("long").alias("id"), F.col("ancestor_id").cast("long").alias("ancestor_id")), pairs, mark_as=names[0])
    of = walked.select(*k, F.col("id").alias(names[0]), F.col("_t").alias(names[1]))
    found = met.join(of, [*k, names[0]]).select(*k, "_t", names[0], names[1])
    out = df.withColumn("_t", F.col("origin_time").cast("double")).join(found, [*k, "_t"])
    return out.withColumn(names[2], F.col("_t") - F.col(names[1])).select(*df.columns, *names)
