"""Sampling of tips, and trees cut down to the sampled ones.

Draws are by hash of id and seed: the same in any partitioning, and equal to
the usual uniform draw in distribution. Ties go by row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions.columns import is_root
from grove.operators.checks import position
from grove.operators.marks import mark_leaves, mark_num_leaves, mask_descendants, with_parent
from grove.operators.pairs import calc_mrca_id_vector
from grove.operators.transforms import prune_extinct_lineages
from grove.plans.folds import keys
from grove.plans.lookup import look_up
from grove.plans.numbering import numbered
from grove.plans.scratch import cut

SAMPLED = "sampled"
#: Sampled rows that each task may hold.
FEW = 10_000


def _best(df: DataFrame, eligible: Column, n: int, order: list[Column | str], mark_as: str, by: list[Column | str] | None = None) -> DataFrame:
    """Mark the first ``n`` eligible rows of each tree (and group); only those are ordered."""
    k = keys(df)
    some = df.filter(eligible)
    few = n <= FEW and not (k or by)
    if few:  # each task keeps its first ones
        best = some.orderBy(*order).limit(n)
    elif k or by:  # a rank below a bound is cut off before the shuffle too
        w = Window.partitionBy(*k, *(by or [])).orderBy(*order)
        best = some.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n)
    else:
        best = numbered(some, order, "_at").filter(F.col("_at") < n)
    best = best.select(*k, "id", F.lit(True).alias("_best"))
    return df.join(F.broadcast(best) if few else best, [*k, "id"], "left").withColumn(mark_as, F.coalesce("_best", F.lit(False))).select(*(c for c in df.columns if c != mark_as), mark_as)


def mark_sample_tips_uniform(df: DataFrame, n_sample: int, *, seed: int = 0, mark_as: str = SAMPLED) -> DataFrame:
    tips = mark_leaves(df, mark_as="_leaf")
    return _best(tips, F.col("_leaf"), n_sample, [F.xxhash64("id", F.lit(seed)), "id"], mark_as).drop("_leaf")


def mark_sample_tips(df: DataFrame, n_sample: int, *, seed: int = 0, mark_as: str = SAMPLED) -> DataFrame:
    """Another name of the uniform sample."""
    return mark_sample_tips_uniform(df, n_sample, seed=seed, mark_as=mark_as)


def mark_sample_tips_canopy(df: DataFrame, n_sample: int | None = None, *, criterion: str = "origin_time", mark_as: str = SAMPLED) -> DataFrame:
    """The tips with the largest criterion; without a number all that share the largest."""
    tips = mark_leaves(df, mark_as="_leaf")
    if n_sample is not None:
        return _best(tips, F.col("_leaf"), n_sample, [F.desc(criterion), position(df)], mark_as).drop("_leaf")
    k = keys(df)
    top = tips.filter("_leaf").groupBy(*k).agg(F.max(criterion).alias("_top"))
    out = tips.join(top, k, "left") if k else tips.crossJoin(F.broadcast(top))  # one row
    return out.withColumn(mark_as, F.col("_leaf") & (F.col(criterion) == F.col("_top"))).drop("_leaf", "_top")


def mark_sample_tips_clade(df: DataFrame, n_sample: int, *, seed: int = 0, mark_as: str = SAMPLED) -> DataFrame:
    """The tips of one clade among the largest with at most ``n_sample`` tips, drawn by tip count."""
    k = keys(df)
    sized, _ = cut(with_parent(mark_num_leaves(mark_leaves(df, mark_as="_leaf"), mark_as="_n"), _above="_n"))
    small = F.col("_n") <= n_sample
    candidate = small & ((F.col("_above") > n_sample) | is_root())
    # The least of exponential waiting times with rates n: drawn in proportion to n.
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + 1) / float((1 << 53) + 1)
    wait = -F.log(uniform) / F.col("_n")
    drawn = sized.filter(candidate).groupBy(*k).agg(F.min_by("id", F.struct(wait, F.col("id"))).alias("_drawn"))
    out = sized.join(drawn, k, "left") if k else sized.crossJoin(F.broadcast(drawn))  # one row
    # Where every clade qualifies all tips are taken.
    whole = F.every(small).over(Window.partitionBy(*k)) if k else F.lit(bool(sized.agg(F.every(small)).first()[0]))
    out = mask_descendants(out.withColumn("_whole", whole), ancestor_mask=F.col("id") == F.col("_drawn"), mark_as="_in")
    return out.withColumn(mark_as, F.col("_leaf") & (F.col("_whole") | F.col("_in"))).drop("_leaf", "_n", "_above", "_drawn", "_whole", "_in")


def _off_lineage(df: DataFrame, seed: int, criterion_delta: str, criterion_target: str) -> DataFrame:
    """With _leaf and _delta: how far a node's criterion is from that of its common ancestor with the target tip; null across roots."""
    tips = mark_leaves(df, mark_as="_leaf")
    order = F.struct(F.col(criterion_target), -F.xxhash64("id", F.lit(seed)))
    target = tips.filter("_leaf").agg(F.max_by("id", order)).first()[0]
    if target is None:
        return tips.withColumn("_delta", F.lit(None).cast("double"))
    met = calc_mrca_id_vector(df, target_id=target)
    value = df.select(F.col("id").alias("mrca_id"), F.col(criterion_delta).alias("_at"))
    # Very many tips share a common ancestor with the target.
    joined = look_up(cut(tips.join(met, "id"))[0], value, ["mrca_id"])
    return joined.withColumn("_delta", F.abs(F.col(criterion_delta) - F.col("_at"))).drop("mrca_id", "_at")


def mark_sample_tips_lineage(
    df: DataFrame, n_sample: int, *, seed: int = 0, criterion_delta: str = "origin_time", criterion_target: str = "origin_time", mark_as: str = SAMPLED
) -> DataFrame:
    """The tips that lie least off the lineage of the tip with the largest target criterion."""
    out = _off_lineage(df, seed, criterion_delta, criterion_target)
    eligible = F.col("_leaf") & F.col("_delta").isNotNull()
    return _best(out, eligible, n_sample, ["_delta", position(df)], mark_as).drop("_leaf", "_delta").select(*df.columns, mark_as)


def mark_sample_tips_lineage_stratified(
    df: DataFrame,
    n_sample: int | None = None,
    *,
    seed: int = 0,
    criterion_delta: str = "origin_time",
    criterion_stratify: str = "origin_time",
    criterion_target: str = "origin_time",
    n_tips_per_stratum: int = 1,
    mark_as: str = SAMPLED,
) -> DataFrame:
    """The least off-lineage tips of each stratum; with ``n_sample`` neighbouring strata are merged to so many."""
    if n_sample is not None and n_sample % n_tips_per_stratum:
        raise ValueError("n_sample is no multiple of n_tips_per_stratum")
    out = _off_lineage(df, seed, criterion_delta, criterion_target)
    eligible = F.col("_leaf") & F.col("_delta").isNotNull()
    stratum = F.col(criterion_stratify)
    if n_sample is not None:
        strata = out.filter(eligible).select(criterion_stratify).distinct()
        ranked = numbered(strata, [criterion_stratify], "_rank")
        n = strata.count()
        out = out.join(ranked, criterion_stratify, "left")
        stratum = F.floor(F.col("_rank") * (n_sample // n_tips_per_stratum) / max(n, 1))
    out = out.withColumn("_stratum", stratum)
    return _best(out, eligible, n_tips_per_stratum, ["_delta", position(df)], mark_as, ["_stratum"]).select(*df.columns, mark_as)


def _cut_down(mark: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        kwargs.pop("mark_as", None)
        marked = mark(df, *args, mark_as="_sampled", **kwargs)
        return prune_extinct_lineages(marked, criterion="_sampled", ignore_topological_sensitivity=True).select(df.columns)

    run.__name__ = mark.__name__.replace("mark_sample", "downsample")
    run.__doc__ = f"The lineages of the tips that ``{mark.__name__}`` marks."
    return run


downsample_tips = _cut_down(mark_sample_tips)
downsample_tips_uniform = _cut_down(mark_sample_tips_uniform)
downsample_tips_canopy = _cut_down(mark_sample_tips_canopy)
downsample_tips_clade = _cut_down(mark_sample_tips_clade)
downsample_tips_lineage = _cut_down(mark_sample_tips_lineage)
downsample_tips_lineage_stratified = _cut_down(mark_sample_tips_lineage_stratified)
