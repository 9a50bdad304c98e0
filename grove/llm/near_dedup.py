"""Near-duplicate detection with HyperMinHash signatures.

A document's set of 5-word shingles is hashed to 64 bits. The top 7 bits of a
hash pick one of 128 buckets; the smallest rest in a bucket is kept as its
count of leading zeros and 10 mantissa bits, 16 bits a register. Empty
registers borrow from a bucket that a fixed permutation names, the same for
all documents, so short texts have comparable signatures too.

Stages, each cut by a written table:

1. Signatures of all whole texts (Arrow batches, NumPy).
2. Equal sets become one class, represented by its smallest doc_id, by a
   partially aggregated groupBy: copies never meet as rows.
3. Bands of 4 registers (32 of them) are hashed; per band key only minimum
   and maximum id are aggregated. At a similarity of 0.85 two documents share
   no band with probability (1 - 0.85^4)^32 < 1e-10, at 0.8 (the pipeline's)
   with probability < 5e-8.
4. Every member of a band is a candidate partner of the band's minimum, never
   of all members. The registers' collision-corrected Jaccard estimate drops
   a candidate only beyond six standard errors; the rest is verified on the
   full sets.
5. Components of the verified links (``graph``). Bands whose members still
   lie in different components are resolved exactly: such components form
   families, and the documents outside a family's largest component meet all
   members of their bands in blocks of bounded size, where an inverted index of
   the block's sets counts what they share. A block returns at most the links
   that join its components, and only the graph of components is solved again.

A large family's smallest id is one row in the joins of steps 4 and 5, whose
other side may fill a partition: adaptive execution splits such a partition.
All joins merge. Spark estimates a table by its compressed files and rows
before they are exploded, so a side that passes for a small one may be many
times the driver's memory; nothing that grows with the documents is broadcast.

Defined results: null, empty and blank texts have no shingles, are linked
with nothing and are kept. Texts of one to four words are one shingle. Rows
that repeat a doc_id are one document, linked with whatever any of its texts
is near to, and named alike. Rows without a doc_id are linked with nothing. A
very long text is one row and its set eight bytes a distinct shingle; sets are
never cut. Ties need no rule: components do not depend on order. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from grove.llm.graph import BOUND, connected_components
from grove.llm.scratch import Scratch
from grove.llm.worker import claim, forgettable, rest

REGISTERS, BAND, MANTISSA, WORDS = 128, 4, 10, 5
BANDS = REGISTERS // BAND
_REST = np.uint64(57)  # bits below those that pick the bucket
#: Where an empty register looks for a value, in this order.
_PROBES = np.stack([np.random.default_rng(1_000 + i).permutation(REGISTERS) for i in range(REGISTERS)])
_FACTORS = [np.uint64(x | 1) for x in np.random.default_rng(7).integers(1 << 60, (1 << 63) - 1, WORDS, dtype=np.uint64).tolist()]


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
forgettable(_hashes.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower and bytes.split touch exactly A-Z and [\\x20\\x09-\\x0D]."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    s = h[: n - WORDS + 1] * _FACTORS[0]
    for k in range(1, WORDS):
        s += h[k : n - WORDS + 1 + k] * _FACTORS[k]
    s = np.sort(_mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers (uint16) of a set that isn't empty."""
    bucket = (shingles >> _REST).astype(np.intp)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = shingles[first] & np.uint64((1 << 57) - 1)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits up to the leading one
    zeros = np.minimum(57 - length, 57)
    down = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    up = np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64)
    mantissa = ((rest >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = ((zeros + 1) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    if len(first) < REGISTERS:
        empty = np.flatnonzero(out == 0)
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), (out != 0)[probes].argmax(axis=1)]]
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near_dedup")
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for at in range(0, len(batch), 1000):
            sizes, keys, found = [], [], []
            for text in texts.slice(at, 1000).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 1000), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "registers"],
            )
    rest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of classes from the rows (id, set_key, text) of the documents that represent them."""
    claim("near_dedup")
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for at in range(0, len(batch), 500):
            sets = [shingle_set(x).tobytes() for x in texts.slice(at, 500).to_pylist()]
            # Where a doc_id has several texts, only one of them is the class's.
            own = [xxh3_128_digest(x) == y for x, y in zip(sets, batch.column(1).slice(at, 500).to_pylist(), strict=True)]
            part = pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(sets, pa.binary())], ["id", "shingles"])
            yield part.filter(pa.array(own, pa.bool_()))
    _hashes.clear()
    rest()


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from counts of equal registers, without the matches that chance makes."""
    zeros = np.arange(58)
    at = lambda n: np.exp(-np.outer(n / REGISTERS, 2.0 ** -(zeros + 1))) - np.exp(-np.outer(n / REGISTERS, 2.0**-zeros))
    chance = (at(n_a) * at(n_b)).sum(axis=1) / 2**MANTISSA
    return np.clip((equal / REGISTERS - chance) / (1 - chance), 0, 1)


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("reg_a", "reg_b"))
            n_a, n_b = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            filled = REGISTERS * -np.expm1(-np.minimum(n_a, n_b) / REGISTERS)
            spread = 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))
            keep = (estimate((a == b).sum(axis=1), n_a, n_b) >= threshold - spread) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Components that links within a block join: pivots against visitors, exactly, by an inverted index of the pivots."""

    def run(table: pa.Table) -> pa.Table:
        claim("near_dedup")
        pivot = table["pivot"].to_numpy(zero_copy_only=False)
        component = table["component"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        asking = np.flatnonzero(pivot)
        own = component[asking]
        sizes = np.array([len(sets[i]) for i in asking], np.int64)
        hashes = np.concatenate([*(sets[i] for i in asking), np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(asking), dtype=np.int32), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := joined.get(x, x)) != x:
                joined[x] = joined.get(y, y)
                x = y
            return x

        out: tuple[list[int], list[int]] = ([], [])
        for i in np.flatnonzero(~pivot) if len(hashes) else ():
            first, last = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
            counts = last - first
            at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            common = np.bincount(owner[at], minlength=len(asking))
            for k in np.flatnonzero((100 * common >= percent * (sizes + len(sets[i]) - common)) & (own != component[i])):
                x, y = root(int(component[i])), root(int(own[k]))
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out[0].append(x), out[1].append(y)
        del sets, hashes, owner, order
        rest()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = 500_000, most_links: int = BOUND) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    ``block`` bounds the shingles of the sets that one task of the last step
    compares with others, and of those others half as many; ``most_links``
    bounds the links that one task solves (``graph``).
    """
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(
        docs.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, registers binary"), "signatures"
    )
    shingled = signed.filter("n_shingles > 0 and doc_id is not null")
    repeated = shingled.groupBy("doc_id").count().agg(F.max("count") > 1).first()[0]
    classes = shingled.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min_by("registers", "doc_id").alias("registers"), F.first("n_shingles").alias("n"))
    # A doc_id that has several sets may represent several classes, which then need numbers of their own.
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id() if repeated else F.col("doc")), "classes")
    band = F.substr("registers", F.col("band") * (2 * BAND) + 1, F.lit(2 * BAND))
    rows = classes.select("id", "n", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select(
        F.xxhash64("band", band).alias("key"), "id", "n"
    )
    keys = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    members = scratch.write(rows.join(keys.hint("merge"), "key"), "members")
    signs = scratch.write(classes.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "signs")
    sets = docs.join(signs.select("id", "doc", "set_key").hint("merge"), F.col("doc_id") == F.col("doc")).select("id", "set_key", "text")
    sets = scratch.write(sets.mapInArrow(_sets, "id long, shingles binary"), "sets")
    sets = sets.dropDuplicates(["id"]) if repeated else sets

    # Every member of a band against the band's least; pairs stay dealt by b, of which there are as many as bands at most.
    pairs = members.filter("id > lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).repartition("b").distinct()
    side = lambda c: signs.select(F.col("id").alias(c), F.col("registers").alias(f"reg_{c}"), F.col("n").alias(f"n_{c}")).hint("merge")
    likely = scratch.write(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_likely(percent / 100), "a long, b long"), "likely")
    full = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")).hint("merge")
    found = likely.join(full("b"), "b").join(full("a"), "a").mapInArrow(_verified(percent), "a long, b long")
    if repeated:
        named = shingled.select("doc_id", "set_key").join(classes.select("set_key", "id").hint("merge"), "set_key").select("doc_id", "id").distinct()
        tied = named.join(named.groupBy("doc_id").agg(F.min("id").alias("a")).hint("merge"), "doc_id").select("a", F.col("id").alias("b"))
        found = found.unionByName(tied.filter("a < b"))
    component = connected_components(found, scratch, "links", most_links).hint("merge")

    # What these links leave apart within a band is compared across components.
    labelled = members.join(component, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    apart = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").drop("y")
    open_ = scratch.write(labelled.join(apart.hint("merge"), "key"), "open")
    again = None
    if open_.limit(1).count():
        mixed = open_.filter("x < component").select(F.col("x").alias("a"), F.col("component").alias("b"))
        families = connected_components(mixed, scratch, "families", most_links).select(F.col("id").alias("component"), F.col("component").alias("family"))
        nodes = scratch.write(open_.select("id", "n", "component").distinct().join(families.hint("merge"), "component"), "nodes")
        each = nodes.groupBy("family", "component").agg(F.sum("n").alias("n"))
        # A family's largest component never asks.
        whole = each.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"), F.sum("n").alias("all"))
        blocks = F.greatest(F.ceil(F.col("rest") / block), F.lit(1))
        dealt = nodes.join(scratch.write(whole, "whole").hint("merge"), "family").select(
            "id",
            "component",
            (F.col("component") != F.col("main")).alias("pivot"),
            F.xxhash64("family", F.pmod(F.xxhash64("id"), blocks)).alias("block"),
            F.greatest(F.ceil(F.col("all") * 2 / block), F.lit(1)).alias("parts"),
        )
        asking = scratch.write(dealt.filter("pivot").drop("pivot"), "asking")
        wanted = open_.select("key", "id").join(asking.select("id", "block", "parts").hint("merge"), "id").select("key", "block", "parts").distinct()
        visits = open_.select("key", "id", "component").join(wanted.hint("merge"), "key").select("block", "id", "component", "parts").distinct()
        rows = visits.select("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).alias("part"), "id", "component", F.lit(False).alias("pivot"))
        rows = rows.unionByName(
            asking.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "component", F.lit(True).alias("pivot"))
        )
        more = rows.join(sets.hint("merge"), "id").groupBy("block", "part").applyInArrow(_across(percent), "a long, b long")
        again = connected_components(more, scratch, "again", most_links).select(F.col("id").alias("label"), F.col("component").alias("further"))

    label = F.coalesce("component", "id").alias("label")
    named = classes.select("set_key", "id", "doc").join(component, "id", "left").select("set_key", "doc", label)
    if again is not None:
        named = named.join(again.hint("merge"), "label", "left").select("set_key", "doc", F.coalesce("further", "label").alias("label"))
    if repeated:  # numbers back to documents, and one name for all rows of a doc_id
        named = named.join(named.groupBy("label").agg(F.min("doc").alias("least")).hint("merge"), "label").select("set_key", F.col("least").alias("label"))
        named = shingled.select("doc_id", "set_key").join(named.hint("merge"), "set_key").groupBy("doc_id").agg(F.min("label").alias("label"))
    by = "doc_id" if repeated else "set_key"
    out = signed.select("doc_id", "n_shingles", "set_key").join(named.select(by, "label").hint("merge"), by, "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("label", "doc_id").alias("component_id"),
        F.coalesce("label", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` but for all documents of a component save the smallest doc_id."""
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (
  SELECT a, b, count(*) AS common FROM (
    SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id) GROUP BY 1, 2),
l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.r AS component_id, d.doc_id = m.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(r) AS r FROM c GROUP BY v) m ON m.v = d.doc_id
"""
