"""Mixing sources to target weights by iterative proportional fitting.

A cell is a combination of source, language and topic. Raking scales the
cells' tokens, one margin after the other, until source, language and topic
all have their target shares; a cell's ratio of raked to own tokens is its
documents' weight. Inclusion probabilities are proportional to the weights,
capped at 1, with the factor that makes the expected tokens those asked for
(calibration). A document is taken when a hash of its id, uniform on [0, 1),
is below its probability, so the same documents are taken on every run, in any
partitioning, and a larger budget only adds some.

The cells are aggregated before anything is collected. At most ``most_cells``
of them are raked on the driver, as arrays; beyond that the same rounds run as
joins of cell tables, each round written. Both stop after 200 rounds, or when
no factor of a round is further than 1e-9 from 1.

Topics: a ``topic`` column is used where there is one, else the form of the
text decides: table, markup, symbols, shouting, numbers, short or prose.

Defined results: null labels are a label of their own, and a null text is
empty. A very long text is one row. Empty texts count one token, so that they can be sampled. Labels that
have a target but no documents are left out, the others' targets scaled up. A
null doc_id is hashed as such. Rows that repeat an id share their fate. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.scratch import Scratch

MARGINS = ("source", "lang", "topic")


def form(text: Column) -> Column:
    """The topic of a text without one, by native functions over the whole text."""
    n = F.length(text)
    # In whole numbers, so that a share that is just met is met everywhere.
    over = lambda chars, percent: 100 * (n - F.length(F.translate(text, chars, ""))) > percent * n
    return (
        F.when(n < 200, "short")
        .when(over("|", 2), "table")
        .when(over("<>", 2), "markup")
        .when(over("#$%&*@^~{}[]_=\\", 5), "symbols")
        .when(over("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 30), "shouting")
        .when(over("0123456789", 10), "numbers")
        .otherwise("prose")
    )


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Runs of white space end words: their number without the last, counted without splitting.
    tokens = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(1))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else form(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in (("source", F.col("source")), ("lang", F.col("lang")), ("topic", topic))),
        tokens.alias("tokens"),
    )


def tempered(sums: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares between the own ones (power 1) and equal ones (power 0)."""
    scaled = {k: v**power for k, v in sums.items()}
    return {k: v / sum(scaled.values()) for k, v in scaled.items()}


#: Raking ends after so many rounds, or with one whose factors are all this near to 1.
MOST_ROUNDS, WITHIN = 200, 1e-9


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = MOST_ROUNDS, within: float = WITHIN) -> np.ndarray:
    """Weights of cells such that weighted tokens have the target sums on each margin."""
    now = tokens.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            sums = np.bincount(code, now, len(target))
            factor = np.divide(target, sums, out=np.ones_like(target), where=sums > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            now = now * factor[code]
        if worst < within:
            break
    return now / tokens


def calibrate(tokens: np.ndarray, weights: np.ndarray, wanted: float) -> float:
    """The factor f with sum(tokens * min(1, f * weight)) = wanted, or the least that takes all."""
    order = np.argsort(-weights)
    t, w = tokens[order].astype(float), weights[order]
    # With the j heaviest cells taken whole, f = (wanted - their tokens) / (weighted tokens of the rest).
    whole, rest = np.concatenate(([0.0], np.cumsum(t))), np.concatenate((np.cumsum((t * w)[::-1])[::-1], [0.0]))
    for j in range(len(t)):
        f = (wanted - whole[j]) / rest[j]
        if f * w[j] <= 1:
            return f
    return 1 / w[-1] if len(w) else 1.0


def _rake_tables(cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float, total: float, rounds: int, scratch: Scratch) -> DataFrame:
    """The same rounds where the cells are too many for one machine."""
    spark, now = cells.sparkSession, cells.withColumn("w", F.lit(1.0))
    wanted = {}
    for m in MARGINS:
        if given := (targets or {}).get(m):
            t = spark.createDataFrame(list(given.items()), f"{m} string, share double").join(cells.select(m).distinct(), m)
        else:
            t = cells.groupBy(m).agg(F.pow(F.sum("tokens"), power).alias("share"))
        sums = t.agg(F.sum("share")).first()[0]
        wanted[m] = scratch.write(t.select(m, (F.col("share") / sums * total).alias("target")), f"target-{m}")
    for turn in range(rounds):
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("w")).alias("sum")).join(wanted[m], m, "left")
            factor = F.when(F.col("sum") > 0, F.coalesce("target", F.lit(0.0)) / F.col("sum")).otherwise(1.0)
            now = now.join(sums.select(m, factor.alias(f"by_{m}")), m).withColumn("w", F.col("w") * F.col(f"by_{m}"))
        off = F.greatest(*(F.abs(F.col(f"by_{m}") - 1) for m in MARGINS))
        now = scratch.write(now.select(*MARGINS, "tokens", "w", off.alias("off")), f"round-{turn}")
        worst = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if turn:
            scratch.drop(f"round-{turn - 1}")
        if worst < WITHIN:
            break
    return now


def _calibrate_tables(raked: DataFrame, wanted: float) -> float:
    """``calibrate`` by aggregations: the factor grows, and with it the cells taken whole, until none is added."""
    t, w = F.col("tokens"), F.col("w")
    factor, whole = 0.0, -1
    while True:
        over = w * factor >= 1
        row = raked.agg(F.sum(F.when(over, t).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(t * w)), F.count_if(over)).first()
        if row[2] == whole or not row[1]:
            return factor
        factor, whole = max(factor, (wanted - row[0]) / row[1]), row[2]


def mix(
    docs: DataFrame,
    keep: float = 0.7,
    power: float = 0.7,
    targets: dict[str, dict[str, float]] | None = None,
    seed: int = 42,
    most_cells: int = 200_000,
    rounds: int | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and sampled of every row.

    ``keep`` is the expected share of all tokens. ``targets`` gives shares by
    margin and label (a label without one gets 0); a margin without targets
    gets its own shares tempered by ``power``. ``rounds`` lowers the bound of
    rounds, of joins to itself and of arrays to eight times it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.write(labelled(docs), "rows")
    cells = scratch.write(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if n <= most_cells:
        found = cells.orderBy(*MARGINS).collect()
        tokens = np.array([r.tokens for r in found], np.int64)
        codes, goals = [], []
        for m in MARGINS:
            labels = sorted({r[m] for r in found})
            at = {x: i for i, x in enumerate(labels)}
            code = np.array([at[r[m]] for r in found], np.int64)
            share = (targets or {}).get(m) or tempered(dict(zip(labels, np.bincount(code, tokens, len(labels)), strict=True)), power)
            goal = np.array([share.get(x, 0.0) for x in labels])
            codes.append(code)
            goals.append(goal / max(goal.sum(), 1e-300) * (total or 0))
        weights = rake(tokens, codes, goals, MOST_ROUNDS if rounds is None else 8 * rounds) if n else np.empty(0)
        factor = calibrate(tokens, weights, keep * (total or 0)) if n else 1.0
        table = [(r.source, r.lang, r.topic, float(w), float(min(1.0, factor * w))) for r, w in zip(found, weights, strict=True)]
        # At most most_cells rows.
        ratios = F.broadcast(spark.createDataFrame(table, "source string, lang string, topic string, weight double, probability double"))
    else:
        raked = _rake_tables(cells, targets, power, float(total), MOST_ROUNDS if rounds is None else rounds, scratch)
        factor = _calibrate_tables(raked, keep * total)
        ratios = raked.select(*MARGINS, F.col("w").alias("weight"), F.least(F.lit(1.0), F.col("w") * factor).alias("probability"))
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    out = rows.join(ratios, list(MARGINS)).withColumn("sampled", uniform < F.col("probability"))
    return out.select("doc_id", *MARGINS, "tokens", "weight", "probability", "sampled")


def sample_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are taken."""
    gone = mix(docs, **options).filter(~F.col("sampled")).select("doc_id").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"])
    return docs.join(gone, same, "left_anti").select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
