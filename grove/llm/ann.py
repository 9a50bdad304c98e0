"""Nearest neighbours by inner product, with multi-index hashing of learned binary codes.

Vectors are scaled by the largest norm and given one more component that makes
their length 1, so the largest inner product is the smallest angle. On a
bounded sample (``sample_rows``, smallest hashes of vec_id) a principal
component projection and several rotations are learned (iterative
quantisation, from different starts); signs after each rotation are the bits,
256 in all. Every vector is then indexed.

A block of the index holds its codes in 16 substrings of 16 bits, each with
the table of its distinct values. By the pigeonhole rule a code within Hamming
radius r of a query's agrees with it in some substring up to r // 16 bits (one
less beyond the first r % 16 + 1 substrings); the tables give every such code,
its whole distance is checked, and what lies within r is ranked by exact inner
products in double precision. r is learned too: on the sample it holds 99 % of
the true neighbours. Queries with fewer results than asked for are searched
again with an unlimited radius, which is exact.

Queries are the rows whose vec_id is divisible by 20; they meet the index in
blocks of bounded size. Equal vectors are searched once; of equal candidates
only the ``k + 1`` smallest ids can be in any answer, so only those are kept.

Defined results: vectors that are null, empty, zero, or hold nulls or values
that aren't finite take no part, nor do vectors of another length than the
most common of the sample. Rows that repeat a vec_id and vector are one. Ties
go to the smaller vec_id. Extra columns are ignored. No vectors: no rows.

How much the tables exclude depends on the vectors: ``candidates`` counts it.
Of isotropic ones, whose true neighbours differ from a query in two fifths of
the bits, they give nearly all codes, and only the whole distance excludes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.llm.scratch import Scratch

BITS, PART = 256, 16
PARTS = BITS // PART


@dataclass
class Codes:
    """What turns vectors into codes, and the radius to search."""

    scale: float
    mean: np.ndarray
    turn: np.ndarray  # (dimensions + 1) x BITS
    radius: int = BITS

    def __call__(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of PARTS 16-bit numbers."""
        y = x.astype(np.float64)
        norm = np.sqrt((y * y).sum(axis=1))
        if query:
            y, last = y / norm[:, None], np.zeros(len(y))
        else:
            y, last = y / self.scale, np.sqrt(np.maximum(1 - (norm / self.scale) ** 2, 0))
        bits = (np.column_stack([y, last]) - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def _rotations(z: np.ndarray, n: int, rounds: int = 30) -> list[np.ndarray]:
    """Rotations of ``z`` that bring it near to its own signs, from ``n`` starts."""
    out = []
    for start in range(n):
        r = np.linalg.qr(np.random.default_rng(start).normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        out.append(r)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    return sum(np.bitwise_count(a[:, None, i] ^ b[None, :, i]).astype(np.int16) for i in range(a.shape[1]))


def learn(sample: np.ndarray, scale: float, total: int, k: int, recall: float = 0.99) -> Codes:
    y = sample.astype(np.float64) / scale
    y = np.column_stack([y, np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))])
    mean = y.mean(axis=0)
    _, _, v = np.linalg.svd(y - mean, full_matrices=False)
    v = v[: min(64, len(v))].T
    z = (y - mean) @ v
    turn = np.concatenate([v @ r for r in _rotations(z, -(-BITS // v.shape[1]))], axis=1)[:, :BITS]
    codes = Codes(scale, mean, turn)
    # Neighbours in the sample that are as near as the k-th in the whole table.
    asked = sample[: min(512, len(sample))]
    exact = asked.astype(np.float64) @ sample.astype(np.float64).T
    exact[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = min(max(1, -(-k * len(sample) // max(total, 1))), len(sample) - 1)
    if near > 0 and len(sample) > 50:
        best = np.argpartition(-exact, near - 1, axis=1)[:, :near]
        far = np.take_along_axis(hamming(codes(asked, True), codes(sample, False)), best, axis=1)
        codes.radius = int(np.quantile(far, recall)) + 1
    return codes


def probe(index: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """queries x index, true for every code within ``radius``: substring tables, then whole distances."""
    if radius >= BITS:
        return np.ones((len(queries), len(index)), bool)
    found = candidates(index, queries, radius)
    for i, rows in enumerate(found):  # whole distances only of what the tables give
        at = np.flatnonzero(rows)
        found[i, at] = hamming(queries[i : i + 1], index[at])[0] <= radius
    return found


def candidates(index: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """queries x index, true for every code that agrees with the query in some substring up to the pigeonhole's share of ``radius``."""
    found = np.zeros((len(queries), len(index)), bool)
    each, more = divmod(radius, PARTS)
    for part in range(PARTS):
        most = each if part <= more else each - 1
        if most < 0:
            continue
        values, rows = np.unique(index[:, part], return_inverse=True)
        near = np.bitwise_count(queries[:, part, None] ^ values[None, :]) <= most
        found |= near[:, rows]
    return found


def _search(codes: Codes, k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(table["asks"])
        there = table.filter(pc.invert(table["asks"]))
        out: tuple[list, list, list] = ([], [], [])
        if len(asked) and len(there):
            matrix = lambda t: np.stack([x.values.to_numpy() for x in t["embedding"].combine_chunks()]) if len(t) else None
            q, x = matrix(asked), matrix(there)
            names, ids = asked["id"].to_numpy(), there["ids"].to_pylist()
            least = np.array([min(i) for i in ids])
            coded = codes(x, False)
            x = x.astype(np.float64)
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                hits = probe(coded, codes(some, True), codes.radius)
                for i, row in enumerate(hits):
                    rows = np.flatnonzero(row)
                    scores = (x[rows] * some[i].astype(np.float64)).sum(axis=1)
                    if len(rows) > k:
                        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        rows, scores = rows[keep], scores[keep]
                    order = np.lexsort((least[rows], -scores))
                    best = sorted((-scores[j], v) for j in order for v in ids[rows[j]])[:k]
                    out[0].extend([int(names[at + i])] * len(best))
                    out[1].extend(v for _, v in best)
                    out[2].extend(-s for s, _ in best)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["id", "vec_id", "score"])

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (floats) of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter((F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sample_rows: int = 4096, index_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    # Equal vectors must be equal keys: 0.0 for -0.0.
    rows = valid_vectors(vectors).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    rows = scratch.write(rows, "rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    if not sample:
        return empty
    lengths = [len(r.embedding) for r in sample]
    size = max(sorted(set(lengths)), key=lengths.count)
    rows = rows.filter(F.size("embedding") == size)
    norm = F.sqrt(F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, v: a + v * v))
    scale = rows.agg(F.max(norm)).first()[0] * (1 + 1e-9)

    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    points = scratch.write(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    asking = rows.filter(F.col("vec_id") % every == 0)
    queries = scratch.write(asking.groupBy("embedding").agg(F.min("vec_id").alias("id")), "queries")
    total, members = points.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    codes = learn(np.array([r.embedding for r in sample if len(r.embedding) == size]), scale, total, k)

    def search(asked: DataFrame, codes: Codes, name: str) -> DataFrame:
        n_index, n_query = max(1, -(-total // index_block)), max(1, -(-asked.count() // query_block))
        there = points.select(
            F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"),
            F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n_index)).cast("int").alias("ib"),
            F.lit(False).alias("asks"),
            F.lit(None).cast("long").alias("id"),
            "ids",
            "embedding",
        )
        here = asked.select(
            F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int").alias("qb"),
            F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("ib"),
            F.lit(True).alias("asks"),
            "id",
            F.lit(None).cast("array<long>").alias("ids"),
            "embedding",
        )
        found = there.unionByName(here).groupBy("qb", "ib").applyInArrow(_search(codes, k + 1), "id long, vec_id long, score double")
        best = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
        return scratch.write(found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")), name)

    found = search(queries, codes, "found")
    need = min(k + 1, members)
    short = queries.join(found.filter(F.size("found") >= need), "id", "left_anti")
    if short.limit(1).count():
        again = search(short, Codes(codes.scale, codes.mean, codes.turn), "again")
        found = found.filter(F.size("found") >= need).unionByName(again)
    named = queries.join(found, "id").select("embedding", "found")
    answers = asking.select("vec_id", "embedding").distinct().withColumnRenamed("vec_id", "query_id").join(named, "embedding")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
