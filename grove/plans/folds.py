"""Folds along lineages (``down``) and over clades (``up``), for trees of any size.

Three engines give the same results. Trees of up to ``limit`` rows are folded
in one Arrow task each, by NumPy. Larger ones, found by a count before
anything runs, are raked: rows that nothing hangs on are set aside, level by
level, each a written table, until the rest is small enough for a task. Where
few rows would go, in long chains, the rest is folded by pointer doubling:
joins over ancestors 1, 2, 4, ... steps away, log2(depth) rounds, each a
written table. So depth costs rounds and not recursion, no task ever holds a
large tree, and parents of very many rows do not gather them (``look_up``).

A tree is all rows with one ``tree_id``; without that column the table is one
forest. Nulls of a folded column count as the fold's identity, and for
``last`` as unmarked; NaN spreads, as in IEEE arithmetic. An empty table gives
no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.plans.forest import Forest
from grove.plans.lookup import look_up
from grove.plans.scratch import cut

#: Rows of a tree that one task folds.
LIMIT = 500_000
#: Raking ends where less than this share of the rows would be set aside.
LEAST_RAKED = 0.2
#: What to fold: output -> (column, fold). Folds: sum, prod, max, min, and for lineages first and last.
Folds = Mapping[str, tuple[Column | str, str]]


def keys(df: DataFrame) -> list[str]:
    """Columns that name a row's tree."""
    return ["tree_id"] if "tree_id" in df.columns else []


def largest_tree(df: DataFrame) -> int:
    k = keys(df)
    if not k:
        return df.count()
    return df.groupBy(*k).count().agg(F.max("count")).first()[0] or 0


def _prepared(df: DataFrame, folds: Folds) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The columns to fold under names of their own, and (output, input, fold)."""
    plan = []
    for i, (out, (column, fold)) in enumerate(folds.items()):
        name = f"_fold_{i}"
        df = df.withColumn(name, F.col(column) if isinstance(column, str) else column)
        kind = df.schema[name].dataType
        if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            df = df.withColumn(name, F.col(name).cast("long"))
        else:
            df = df.withColumn(name, F.col(name).cast("double"))
        plan.append((out, name, fold))
    return df, plan


def _identity(fold: str, integer: bool):
    if fold in ("sum", "prod"):
        return int(fold == "prod") if integer else float(fold == "prod")
    low = fold == "max"
    if integer:
        return -(2**63) if low else 2**63 - 1
    return float("-inf") if low else float("inf")


def _kernel(plan: list[tuple[str, str, str]], upward: bool, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].combine_chunks()
        forest = Forest(column("id").cast(pa.int64()).to_numpy(), column("ancestor_id").cast(pa.int64()).to_numpy())
        made = {}
        for out, name, fold in plan:
            data = column(name)
            integer = pa.types.is_integer(data.type)
            if fold == "last":
                at = forest.nearest(~np.asarray(data.is_null()))
                made[out] = data.take(pa.array(at, mask=at < 0)) if len(data) else data
            elif fold == "first":
                made[out] = data.take(pa.array(forest.root))
            else:
                values = data.fill_null(_identity(fold, integer)).to_numpy(zero_copy_only=False)
                made[out] = pa.array(forest.up(values, fold) if upward else forest.down(values, fold))
        return pa.table([made[n] if n in made else table[n] for n in names], names=names)

    return run


def run_kernel(df: DataFrame, function, schema) -> DataFrame:
    """A function of whole trees, one Arrow task each; null ids are refused by its schema."""
    k = keys(df)
    out = df.groupBy(*k).applyInArrow(function, schema)
    # Without keys all rows come from one task, which what follows would share.
    return out if k or "id" not in out.columns else out.repartition("id")


_OPS = {
    "sum": (lambda a, b: a + b, F.sum),
    "prod": (lambda a, b: a * b, F.product),
    "max": (F.greatest, F.max),
    "min": (F.least, F.min),
    "first": (lambda a, b: a, None),
    "last": (lambda a, b: F.coalesce(b, a), None),
}


def _filled(df: DataFrame, plan: list[tuple[str, str, str]]) -> DataFrame:
    """With the folds' identities for nulls."""
    integer = {n: isinstance(df.schema[n].dataType, T.LongType) for _, n, _ in plan}
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(_identity(f, integer[n]))) for _, n, f in plan if f not in ("first", "last")})


def _gathered(rows: DataFrame, parent: str, plan: list[tuple[str, str, str]]) -> DataFrame:
    """Folds of the rows with one parent, under its id."""
    folded = (_OPS[f][1](F.col(n)).cast(rows.schema[n].dataType).alias(f"below{n}") for _, n, f in plan)
    return rows.groupBy(*keys(rows), F.col(parent).alias("id")).agg(*folded)


def _with_gathered(rows: DataFrame, gathered: DataFrame, plan: list[tuple[str, str, str]]) -> DataFrame:
    joined = rows.join(gathered, [*keys(rows), "id"], "left")
    merged = {n: F.when(F.col(f"below{n}").isNull(), F.col(n)).otherwise(_OPS[f][0](F.col(n), F.col(f"below{n}"))) for _, n, f in plan}
    return joined.withColumns(merged).select(rows.columns)


def _doubled(df: DataFrame, plan: list[tuple[str, str, str]], upward: bool) -> DataFrame:
    k = keys(df)
    names = [n for _, n, _ in plan]
    up_to = F.when(F.col("id") != F.col("ancestor_id"), F.col("ancestor_id")).cast("long")
    state, path = cut(_filled(df, plan).select(*k, F.col("id").cast("long").alias("id"), up_to.alias("up"), *names))
    while state.filter(F.col("up").isNotNull()).limit(1).count():
        moving, ended = state.filter(F.col("up").isNotNull()), state.filter(F.col("up").isNull())
        above = state.select(*k, F.col("id").alias("up"), F.col("up").alias("further"), *(F.col(n).alias(f"above{n}") for n in names if not upward))
        step = look_up(moving, above, [*k, "up"])
        if upward:
            stepped = step.select(*k, "id", F.col("further").alias("up"), *names).unionByName(ended)
            step = _with_gathered(stepped, _gathered(moving, "up", plan), plan)
        else:
            merged = [_OPS[f][0](F.col(f"above{n}"), F.col(n)).alias(n) for _, n, f in plan]
            step = step.select(*k, "id", F.col("further").alias("up"), *merged).unionByName(ended)
        state, path = cut(step, drop=path)
    return state.select(*k, "id", *(F.col(n).alias(o) for o, n, _ in plan))


def _in_tasks(wide: DataFrame, kept: list[str], plan: list[tuple[str, str, str]], upward: bool) -> DataFrame:
    """Folded in one task a tree."""
    schema = T.StructType([wide.schema[c] for c in kept] + [T.StructField(o, wide.schema[n].dataType) for o, n, _ in plan])
    return run_kernel(wide, _kernel(plan, upward, schema.names), schema)


def _in_rounds(wide: DataFrame, kept: list[str], plan: list[tuple[str, str, str]], upward: bool) -> DataFrame:
    """Folded by pointer doubling."""
    done = _doubled(wide, plan, upward)
    done = done.withColumn("id", F.col("id").cast(wide.schema["id"].dataType))
    return wide.select(*kept).join(done, [*keys(wide), "id"]).select(*kept, *(o for o, _, _ in plan))


def _raked(wide: DataFrame, kept: list[str], plan: list[tuple[str, str, str]], upward: bool, limit: int) -> DataFrame:
    """Folded by setting aside, level by level, the rows that nothing hangs on; their children's folds, if any, are in them by then."""
    k, root = keys(wide), F.col("id") == F.col("ancestor_id")
    outs = [o for o, _, _ in plan]
    rows = _filled(wide, plan).select(*kept, *(n for _, n, _ in plan))
    links, levels, n = rows, [], None
    while True:
        inner = links.filter(~root).select(*k, F.col("ancestor_id").alias("id")).distinct().withColumn("_inner", F.lit(True))
        flagged, _ = cut(rows.join(inner, [*k, "id"], "left").withColumn("_inner", F.col("_inner").isNotNull()))
        tips, links = (flagged.filter(c).drop("_inner") for c in (~F.col("_inner"), F.col("_inner")))
        n, rest = flagged.count() if n is None else n, links.count()
        if n - rest < LEAST_RAKED * n:
            core = _in_rounds(flagged.drop("_inner"), kept, plan, upward)
            break
        rows, n = _with_gathered(links, _gathered(tips.filter(~root), "ancestor_id", plan), plan) if upward else links, rest
        levels.append(tips)
        if (largest_tree(links) if k else rest) <= limit:
            core = _in_tasks(rows, kept, plan, upward)
            break
    pieces = [cut(core)[0]]
    for tips in reversed(levels):
        if upward:
            pieces.append(tips.select(*kept, *(F.col(n).alias(o) for o, n, _ in plan)))
            continue
        above = functools.reduce(DataFrame.unionByName, pieces).select(*k, F.col("id").alias("ancestor_id"), *(F.col(o).alias(f"above{n}") for o, n, _ in plan))
        folded = [F.when(root, F.col(n)).otherwise(_OPS[f][0](F.col(f"above{n}"), F.col(n))).alias(o) for o, n, f in plan]
        pieces.append(cut(look_up(tips, above, [*k, "ancestor_id"]).select(*kept, *folded))[0])
    return functools.reduce(DataFrame.unionByName, pieces).select(*kept, *outs)


def _fold(df: DataFrame, folds: Folds, upward: bool, engine: str, limit: int) -> DataFrame:
    kept = [c for c in df.columns if c not in folds]
    wide, plan = _prepared(df, folds)
    if engine == "auto":
        engine = "kernel" if largest_tree(df) <= limit else "raking"
    if engine == "kernel":
        return _in_tasks(wide, kept, plan, upward)
    if engine == "doubling":
        return _in_rounds(wide, kept, plan, upward)
    return _raked(wide, kept, plan, upward, limit)


def down(df: DataFrame, folds: Folds, *, engine: str = "auto", limit: int = LIMIT) -> DataFrame:
    """Add columns folded from the root to each row, both included."""
    return _fold(df, folds, False, engine, limit)


def up(df: DataFrame, folds: Folds, *, engine: str = "auto", limit: int = LIMIT) -> DataFrame:
    """Add columns folded over each row's clade, the row included."""
    return _fold(df, folds, True, engine, limit)


def _walk_kernel(descending: bool):
    def run(table: pa.Table) -> pa.Table:
        ids, above = (table[c].combine_chunks().cast(pa.int64()).to_numpy() for c in ("id", "ancestor_id"))
        forest = Forest(ids, above)
        n = forest.n
        size = forest.up(np.ones(n, np.int64), "sum")
        # Children of one parent after one another; so are roots.
        parent = np.where(forest.is_root, -1, forest.parent)
        rows = np.lexsort((-ids if descending else ids, parent))
        passed = np.cumsum(size[rows]) - size[rows]
        first = np.concatenate(([True], parent[rows][1:] != parent[rows][:-1]))[:n]
        base = passed[first][np.cumsum(first) - 1] if n else passed
        step = np.empty(n, np.int64)
        step[rows] = passed - base
        pre = forest.down(step + ~forest.is_root, "sum")
        for name, values in (("size", size), ("pre", pre), ("depth", forest.depth), ("post", pre + size - 1 - forest.depth)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return run


def euler(df: DataFrame, *, descending: bool = False, engine: str = "auto", limit: int = LIMIT) -> DataFrame:
    """Add depth, size, pre and post: numbers of a depth-first walk, children by id, roots by id.

    u lies in the clade of v just if pre(v) <= pre(u) < pre(v) + size(v).
    """
    from grove.plans.numbering import before_in_group

    if engine == "auto":
        engine = "kernel" if largest_tree(df) <= limit else "raking"
    k = keys(df)
    if engine == "kernel":
        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("size", "pre", "depth", "post"))])
        return run_kernel(df, _walk_kernel(descending), schema)
    with_size = up(df, {"size": (F.lit(1), "sum")}, engine=engine, limit=limit)
    root = F.col("id") == F.col("ancestor_id")
    # Roots come after one another like children of one parent.
    beside = with_size.withColumns({"_root": root, "_under": F.when(root, F.lit(0)).otherwise(F.col("ancestor_id")).cast("long")})
    placed = before_in_group(beside, [*k, "_root", "_under"], [F.col("id").desc() if descending else F.col("id")], "_step", sum_of="size")
    step = F.when(root, F.lit(0)).otherwise(F.lit(1))
    moved = placed.drop("_root", "_under").withColumn("_step", F.col("_step") + step)
    walked = down(moved, {"pre": ("_step", "sum"), "depth": (step, "sum")}, engine=engine, limit=limit).drop("_step")
    return walked.withColumn("post", F.col("pre") + F.col("size") - 1 - F.col("depth"))
