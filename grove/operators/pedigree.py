"""Tables whose rows may have several parents: ``ancestor_list`` without ``ancestor_id``.

Their parents are rows of an edge table. What runs along lineages is found by
relaxation: rounds of one join and one aggregation over the edges, as many as
the longest run that a value has to pass, each a written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.columns import ANCESTOR, ID, LIST, is_root, parse_ancestor_ids
from grove.plans.folds import down, keys
from grove.plans.lookup import look_up
from grove.plans.scratch import cut


def has_one_parent(df: DataFrame) -> bool:
    return ANCESTOR in df.columns


def root(df: DataFrame) -> Column:
    """Whether a row is a root, from whatever names its parents."""
    return is_root() if has_one_parent(df) else F.coalesce(F.size(parse_ancestor_ids(F.col(LIST))) == 0, F.lit(False))


def edges(df: DataFrame) -> DataFrame:
    """The rows of ``df`` but for roots, one for each of their parents, ``ancestor_id``."""
    return df.filter(~is_root()) if has_one_parent(df) else df.withColumn(ANCESTOR, F.explode(parse_ancestor_ids(F.col(LIST))))


def list_text(ids: Column, empty: Column | str = "[none]") -> Column:
    """An array of ids as the text of a list."""
    text = F.concat(F.lit("["), F.concat_ws(", ", F.transform(ids, lambda x: x.cast("string"))), F.lit("]"))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, text).otherwise(F.lit(empty) if isinstance(empty, str) else empty)


def relax(df: DataFrame, start: Column, *, largest: bool = True, carry: Callable[[Column], Column] = lambda above: above) -> DataFrame:
    """(tree, id, value): the largest (or least) of a row's own value and what its ancestors' values carry down."""
    k = keys(df)
    fold, merge = (F.max, F.greatest) if largest else (F.min, F.least)
    links, _ = cut(edges(df).select(*k, ID, F.col(ANCESTOR).alias("_up")))
    state, path = cut(df.select(*k, ID, start.alias("value")))
    while True:
        above = state.select(*k, F.col(ID).alias("_up"), F.col("value").alias("_above"))
        best = look_up(links, above, [*k, "_up"]).groupBy(*k, ID).agg(fold(carry(F.col("_above"))).alias("_best"))
        step = state.join(best, [*k, ID], "left").select(*k, ID, merge("value", "_best").alias("value"), (~merge("value", "_best").eqNullSafe(F.col("value"))).alias("_moved"))
        state, path = cut(step, drop=path)
        if not state.filter("_moved").limit(1).count():
            return state.drop("_moved")


def pedigree_depth(df: DataFrame, *, mark_as: str) -> DataFrame:
    """The longest way up from an organism with any number of parents."""
    depth = relax(df, F.lit(0).cast("long"), carry=lambda above: above + 1)
    return df.join(depth.withColumnRenamed("value", mark_as), [*keys(df), ID])


def root_ids(df: DataFrame, selector: str) -> DataFrame:
    """(tree, id, value): the least or the largest of the roots that a row comes from."""
    if selector not in ("min", "max"):
        raise ValueError(f"selector is min or max, not {selector}")
    return relax(df, F.when(root(df), F.col(ID)), largest=selector == "max")


def kept_of_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Masked rows, each on all masked ancestors that it reaches by rows outside the mask."""
    k = keys(df)
    token = df.filter(root(df)).select(LIST).limit(1).collect()
    links, _ = cut(edges(df.withColumn("_in", F.coalesce(mask, F.lit(False)))).select(*k, ID, F.col(ANCESTOR).alias("_up"), "_in"))
    inside = df.filter(mask).select(*k, F.col(ID).alias("_up"), F.lit(True).alias("_met"))
    further = links.select(*k, F.col(ID).alias("_up"), F.col("_up").alias("_next"))
    ways, found = links.filter("_in").select(*k, ID, "_up"), None
    while True:
        ways, _ = cut(ways.distinct().join(inside, [*k, "_up"], "left"))
        ended = ways.filter("_met").select(*k, ID, "_up")
        found = ended if found is None else found.unionByName(ended)
        if not ways.filter("_met is null").limit(1).count():
            break
        ways = ways.filter("_met is null").drop("_met").join(further, [*k, "_up"]).select(*k, ID, F.col("_next").alias("_up"))
    lists = found.groupBy(*k, ID).agg(F.array_sort(F.collect_set("_up")).alias("_a"))  # an organism's few ancestors
    out = df.filter(mask).join(lists, [*k, ID], "left")
    return out.withColumn(LIST, list_text(F.col("_a"), token[0][0] if token else "[none]")).select(df.columns)


def without_unifurcations(df: DataFrame, root_ancestor_token: str) -> DataFrame:
    """Without rows of one parent and one child; what hung on them hangs on their nearest ancestor that stays."""
    k = keys(df)
    counts = edges(df).groupBy(*k, F.col(ANCESTOR).alias(ID)).agg(F.count(F.lit(1)).alias("_n"))
    parents = parse_ancestor_ids(F.col(LIST))
    goes = (F.size(parents) == 1) & (F.coalesce("_n", F.lit(0)) == 1)
    marked, _ = cut(df.join(counts, [*k, ID], "left").withColumns({"_goes": F.coalesce(goes, F.lit(False)), "_parents": parents}))
    # Rows that go hang on their parent, all others are roots: a forest, whose roots are the rows that stay.
    chains = marked.select(*k, ID, F.when(F.col("_goes"), F.col("_parents")[0]).otherwise(F.col(ID)).alias(ANCESTOR))
    stays = down(chains, {"_to": (F.col(ID), "first")}).select(*k, F.col(ID).alias("_old"), "_to")
    staying = marked.filter(~F.col("_goes"))
    links = look_up(staying.select(*k, ID, F.posexplode("_parents").alias("_at", "_old")), stays, [*k, "_old"]).filter(F.col("_to").isNotNull())
    lists = links.groupBy(*k, ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_to"))), lambda x: x["_to"]).alias("_a"))
    return staying.join(lists, [*k, ID], "left").withColumn(LIST, list_text(F.col("_a"), f"[{root_ancestor_token}]")).select(df.columns)
