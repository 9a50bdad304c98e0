"""Expressions over the columns of a tree table, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID, ANCESTOR, LIST = "id", "ancestor_id", "ancestor_list"


def is_root() -> Column:
    return F.col(ID) == F.col(ANCESTOR)


def ieee_div(a: Column, b: Column) -> Column:
    """Division as in IEEE 754: x/0 is an infinity and 0/0 is NaN, where ANSI mode raises."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(F.try_divide(a, b))


def parse_ancestor_id(ancestor_list: Column) -> Column:
    """The one ancestor of a list's text; null for a root."""
    return F.try_to_number(F.regexp_extract(ancestor_list, r"^\s*\[\s*(\d+)\s*\]\s*$", 1), F.lit("9" * 18)).cast("bigint")


def parse_ancestor_ids(ancestor_list: Column) -> Column:
    """All ancestors of a list's text, none for a root; null for what is no list."""
    text = F.when(F.lower(ancestor_list).isin("[none]", "[]"), F.lit("[]")).otherwise(ancestor_list)
    return F.from_json(text, "array<bigint>")


def make_ancestor_id(id_: Column, ancestor_list: Column) -> Column:
    """Ancestor of an asexual list; a root is its own."""
    return F.coalesce(parse_ancestor_id(ancestor_list), id_.cast("bigint"))


def make_ancestor_list(id_: Column, ancestor_id: Column, root_ancestor_token: str = "none") -> Column:
    return F.when(id_ == ancestor_id, F.lit(f"[{root_ancestor_token}]")).otherwise(F.concat(F.lit("["), ancestor_id.cast("string"), F.lit("]")))


def convert_root_ancestor_token(ancestor_list: Column, root_ancestor_token: str) -> Column:
    """The list with another word for a root."""
    return F.when(F.lower(ancestor_list).isin("[none]", "[]"), F.lit(f"[{root_ancestor_token}]")).otherwise(ancestor_list)
