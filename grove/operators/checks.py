"""Predicates, validation, search and stale columns.

Predicates are frames of one row with a boolean ``result``; row order is the
order of a ``pos`` column where there is one, else of ``id``.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.functions.columns import is_root, parse_ancestor_ids
from grove.operators.marks import mark_leaves, with_parent
from grove.operators.pedigree import edges, has_one_parent, root
from grove.plans.folds import keys
from grove.plans.numbering import numbered


def position(df: DataFrame) -> str:
    return "pos" if "pos" in df.columns else "id"


def _result(df: DataFrame, condition) -> DataFrame:
    """True where the condition holds for all rows, also for none."""
    return df.agg(F.coalesce(F.every(condition), F.lit(True)).alias("result"))


def has_compact_ids(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("id") == F.count(F.lit(1)) - 1, F.lit(True)).alias("result"))


def has_contiguous_ids(df: DataFrame) -> DataFrame:
    """id is the row number within a tree, in the order of ``pos`` or, without it, of id."""
    k, pos = keys(df), position(df)
    if pos == "id":  # the order of id numbers rows by id just if the ids are 0, 1, 2, ...
        each = df.groupBy(*k).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"))
        return _result(each, (F.col("n") == 0) | ((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n"))))
    return _result(numbered(df.select(*k, "id", pos), [pos], "_row"), F.col("id") == F.col("_row"))


def has_increasing_ids(df: DataFrame) -> DataFrame:
    return _result(df, F.col("id") >= F.col("ancestor_id"))


def has_multiple_roots(df: DataFrame) -> DataFrame:
    return df.agg((F.count_if(is_root()) >= 2).alias("result"))


def is_sexual(df: DataFrame) -> DataFrame:
    if "ancestor_list" not in df.columns:
        return df.limit(0).agg(F.lit(False).alias("result"))
    return df.agg(F.coalesce(F.bool_or(F.contains("ancestor_list", F.lit(","))), F.lit(False)).alias("result"))


def is_asexual(df: DataFrame) -> DataFrame:
    if "ancestor_id" in df.columns:
        return df.limit(0).agg(F.lit(True).alias("result"))
    return is_sexual(df).select((~F.col("result")).alias("result"))


def _with_parents(df: DataFrame, column: str) -> DataFrame:
    """A row for each parent of each row, with that parent's ``column`` as ``_above``."""
    k = keys(df)
    return edges(df).join(df.select(*k, F.col("id").alias("ancestor_id"), F.col(column).alias("_above")), [*k, "ancestor_id"])


def is_topologically_sorted(df: DataFrame) -> DataFrame:
    """No row stands before one of its ancestors."""
    if not has_one_parent(df):
        return _result(_with_parents(df, position(df)), F.col("_above") < F.col(position(df)))
    return _result(with_parent(df, _above=position(df)), F.col("_above") <= F.col(position(df)))


def is_chronologically_sorted(df: DataFrame, how: str = "origin_time") -> DataFrame:
    """``how`` never falls along the rows of a tree."""
    if how not in df.columns:
        return df.limit(0).agg(F.lit(False).alias("result"))
    rows = numbered(df.select(*dict.fromkeys([*keys(df), position(df), how])), [position(df)], "_before", lag_of=how)
    return _result(rows, F.col("_before").isNull() | (F.col("_before") <= F.col(how)))


def find_chronological_inconsistency(df: DataFrame) -> DataFrame:
    """The first row older than its ancestor: one row, null where there is none."""
    above = with_parent(df, _above="origin_time") if has_one_parent(df) else _with_parents(df, "origin_time")
    older = above.filter(F.col("origin_time") < F.col("_above"))
    return older.agg(F.min_by("id", position(df)).alias("id"))


def is_chronologically_ordered(df: DataFrame) -> DataFrame:
    return find_chronological_inconsistency(df).select(F.col("id").isNull().alias("result"))


def is_strictly_bifurcating(df: DataFrame) -> DataFrame:
    counts = df.filter(~is_root()).groupBy(*keys(df), "ancestor_id").count()
    return _result(counts, F.col("count") == 2)


def is_working_format(df: DataFrame) -> DataFrame:
    """ancestor_id is there, parents come first, ids are row numbers."""
    if "ancestor_id" not in df.columns:
        return df.limit(0).agg(F.lit(False).alias("result"))
    # Where ids are row numbers, a parent comes first just if its id is not larger.
    return has_contiguous_ids(df).crossJoin(has_increasing_ids(df).withColumnRenamed("result", "_rises")).select((F.col("result") & F.col("_rises")).alias("result"))


def is_ultrametric(df: DataFrame, *, atol: float = 0.0) -> DataFrame:
    """Tips end within ``atol`` of one another; ValueError for a tip without a time."""
    tips = mark_leaves(df, mark_as="_leaf").filter("_leaf")
    time = F.col("origin_time").cast("double")
    found = tips.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count_if(time.isNull() | F.isnan(time)).alias("bad"))
    if found.first().bad:
        raise ValueError("a tip has no origin_time")
    return found.select(F.coalesce(F.col("b") - F.col("a") <= atol, F.lit(True)).alias("result"))


def find_leaf_ids(df: DataFrame) -> DataFrame:
    return mark_leaves(df, mark_as="_leaf").filter("_leaf").select(*keys(df), "id")


def find_root_ids(df: DataFrame) -> DataFrame:
    return df.filter(root(df)).select(*keys(df), "id")


def validate(df: DataFrame, *, diagnose: bool = True) -> bool:
    """Whether a table keeps the rules of the format; warns which one it breaks."""

    def bad(why: str) -> bool:
        if diagnose:
            warnings.warn(why, stacklevel=3)
        return False

    for name in ("id", "ancestor_list"):
        if name not in df.columns:
            return bad(f"no column {name}")
    if not isinstance(df.schema["id"].dataType, T.IntegralType):
        return df.limit(1).count() == 0 or bad("ids are not integers")
    k = keys(df)
    parsed = parse_ancestor_ids(F.col("ancestor_list"))
    form = F.col("ancestor_list").rlike(r"^\[\s*((?i:none)|(\d+\s*(,\s*\d+\s*)*))?\]$")
    rules = {
        "an id is missing or negative": F.count_if(F.col("id").isNull() | (F.col("id") < 0)),
        "an ancestor_list is malformed": F.count_if(~F.coalesce(form & parsed.isNotNull(), F.lit(False))),
        "ids repeat": F.count(F.lit(1)) - F.count_distinct(*k, "id"),
    }
    if "ancestor_id" in df.columns:
        agrees = F.when(F.size(parsed) == 0, F.col("ancestor_id") == F.col("id")).otherwise((F.size(parsed) == 1) & (parsed[0] == F.col("ancestor_id")))
        rules["ancestor_id differs from ancestor_list"] = F.count_if(~F.coalesce(agrees, F.lit(False)))
    found = df.agg(*(c.alias(str(i)) for i, c in enumerate(rules.values()))).first()
    for why, n in zip(rules, found, strict=True):
        if n:
            return bad(why)
    asked = df.select(*k, F.explode(parsed).alias("id")).distinct()
    if asked.join(df.select(*k, F.col("id").cast("bigint").alias("id")), [*k, "id"], "left_anti").limit(1).count():
        return bad("an ancestor is no id")
    return True


# ---------------------------------------------------------------- columns that changes make stale
# Names of derived columns, and what makes them stale.

UPDATE_ONLY = ("ancestor_origin_time", "branch_length", "edge_length", "node_depth", "origin_time_delta")
GENERAL = (
    "csr_children", "csr_offsets", "clade_duration", "clade_duration_ratio_sister", "clade_fblr_growth_children", "clade_fblr_growth_sister",
    "clade_faithpd", "clade_leafcount_ratio_sister", "clade_logistic_growth_children", "clade_logistic_growth_sister",
    "clade_nodecount_ratio_sister", "clade_subtended_duration", "clade_subtended_duration_ratio_sister", "colless_index",
    "colless_index_corrected", "colless_like_index_mdm", "colless_like_index_sd", "colless_like_index_var", "first_child_id",
    "is_left_child", "is_right_child", "left_child_id", "max_descendant_origin_time", "next_sibling_id", "num_children",
    "num_descendants", "num_leaves", "num_leaves_sibling", "num_preceding_leaves", "ot_mrca_id", "ot_mrca_time_of",
    "ot_mrca_time_since", "prev_sibling_id", "right_child_id", "sackin_index", "sister_id",
)


def check_topological_sensitivity(df: DataFrame, *, insert: bool, delete: bool, update: bool) -> list[str]:
    """Columns of ``df`` that such changes make stale; no job runs."""
    stale = set(GENERAL if insert or delete or update else ()) | set(UPDATE_ONLY if update else ())
    return [c for c in df.columns if c in stale]


def warn_topological_sensitivity(df: DataFrame, caller: str, *, insert: bool, delete: bool, update: bool) -> None:
    found = check_topological_sensitivity(df, insert=insert, delete=delete, update=update)
    if found:
        warnings.warn(f"{caller} may make these columns stale: {', '.join(found)}", stacklevel=3)


def drop_topological_sensitivity(df: DataFrame, *, insert: bool = True, delete: bool = True, update: bool = True) -> DataFrame:
    return df.drop(*check_topological_sensitivity(df, insert=insert, delete=delete, update=update))


def topological_sensitivity_warned(*, insert: bool, delete: bool, update: bool) -> Callable:
    """Give a transform the options to drop stale columns or to be silent about them."""

    def wrap(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(df: DataFrame, *args, ignore_topological_sensitivity: bool = False, drop_topological_sensitivity: bool = False, **kwargs):
            stale = check_topological_sensitivity(df, insert=insert, delete=delete, update=update)
            if drop_topological_sensitivity:
                df = df.drop(*stale)
            elif stale and not ignore_topological_sensitivity:
                warnings.warn(f"{function.__name__} may make these columns stale: {', '.join(stale)}", stacklevel=2)
            return function(df, *args, **kwargs)

        return run

    return wrap
