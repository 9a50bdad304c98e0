"""Language-model scores from a weighted backoff automaton over n-grams.

States are histories of up to ``order - 1`` tokens seen in training, with the
empty history as root. A state has an arc for each token seen after it, and a
failure arc to the state of its history without the first token. With c the
training count,

    p(w | h) = s c(h w) / c(h) + (1 - s) p(w | h'),

so an arc weighs log10 p(w | h), a failure arc log10(1 - s), and the root
gives (c + 0.5) / (N + 0.5 (V + 1)). A text is read once from left to right,
each token from the longest known state, down failure arcs until an arc fits;
weights are added up. The probabilities of all tokens after a history sum to
one (an unknown token stands for all unknown ones).

s depends on the order and on the class of c(h), and is the share of training
tokens in such places that would still be known with that one occurrence left
out: of the tokens after histories of count c(h) + 1, those whose n-gram
occurs more than once. Singletons lie in one block, so blocks count this
apart and only a few sums come together.

No task ever holds the whole automaton. Texts are packed into blocks of
bounded size (``block_bytes``), each with its own vocabulary. A block sends
its distinct n-grams (64-bit hashes, sorted, in byte planes) with their
training counts to the partitions of the hash space; a partition sums the
counts over all blocks and returns to each block the totals of just the
n-grams it sent. That part of the automaton is what the block's texts can
reach, so each block is then scored by itself. What is shuffled grows with the
corpus; a frequent n-gram is one entry a block, never one a text.

Defined results: null, empty and blank texts hold the end token alone. A null
doc_id counts as training. Rows are independent but for the counts, so
repeated rows count twice. With no training texts N is 0 and all scores are
those of the root. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from grove.llm.scratch import Scratch

#: Words hold no white space, so these names are free.
START, END = b" <", b" >"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Local(dict):
    """Words of a block, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _pack(*arrays: np.ndarray) -> bytes:
    data = pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)
    return np.array([len(a) for a in arrays], np.int64).tobytes() + np.int64(sum(a.nbytes for a in arrays)).tobytes() + data


def _unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    n = len(dtypes)
    lengths, size = np.frombuffer(data, np.int64, n), int(np.frombuffer(data, np.int64, 1, 8 * n)[0])
    raw, at, out = pa.decompress(data[8 * (n + 1) :], size, codec="zstd", asbytes=True), 0, []
    for length, dtype in zip(lengths, dtypes, strict=True):
        out.append(np.frombuffer(raw, dtype, int(length), at))
        at += int(length) * np.dtype(dtype).itemsize
    return out


_FIELDS = (np.int64, np.bool_, np.bool_, np.int32, np.int32, np.uint64)


def _blocks(held_out: int, folds: int, block_bytes: int):
    """Texts to blocks: doc_ids, null ids, training flags, lengths, token numbers, and the hashes of the numbered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        words, held, ids, lengths, tokens = _Local({START: 0, END: 1}), 0, [], [], []

        def block() -> pa.RecordBatch:
            nonlocal words, held, ids, lengths, tokens, n
            known = np.array([x is not None for x in ids])
            train = np.array([x is None or zlib.crc32(str(x).encode()) % folds != held_out for x in ids])
            hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
            stream = np.concatenate(tokens)
            data = _pack(np.array([x or 0 for x in ids], np.int64), known, train, np.array(lengths, np.int32), stream, hashes)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | n], pa.int64()), pa.array([len(stream)], pa.int64()), pa.array([int(train.sum())], pa.int64()), pa.array([data], pa.binary())],
                ["block", "tokens", "train_docs", "data"],
            )
            words, held, ids, lengths, tokens, n = _Local({START: 0, END: 1}), 0, [], [], [], n + 1
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(batch), 1000):
                for doc, text in zip(batch.column(0).slice(at, 1000).to_pylist(), texts.slice(at, 1000).to_pylist(), strict=True):
                    # bytes.lower and bytes.split touch exactly A-Z and [\x20\x09-\x0D].
                    found = text.lower().split() if text else []
                    stream = np.empty(len(found) + 2, np.int32)
                    stream[0], stream[-1] = 0, 1
                    stream[1:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                    ids.append(doc), lengths.append(len(stream)), tokens.append(stream)
                    held += len(text or b"") + 64
                    if held >= block_bytes:
                        yield block()
        if ids:
            yield block()

    return run


class Block:
    """A block's n-grams: per order, where they end, which one it is, and the distinct ones' hashes."""

    def __init__(self, data: bytes, order: int):
        self.ids, self.known, self.train, self.lengths, stream, self.hashes = _unpack(data, *_FIELDS)
        starts = np.cumsum(self.lengths) - self.lengths
        self.starts, n = starts, len(stream)
        place = np.arange(n, dtype=np.int64) - np.repeat(starts, self.lengths)
        trained = np.repeat(self.train, self.lengths)
        width = np.int64(len(self.hashes))
        #: By order: for each token of the stream the number of the n-gram that ends there, or -1.
        self.at: list[np.ndarray] = [stream.astype(np.int64)]
        self.keys: list[np.ndarray] = [_mix(self.hashes)]
        self.counts: list[np.ndarray] = [np.bincount(stream[trained], minlength=len(self.hashes)).astype(np.uint32)]
        plain = self.hashes
        for k in range(2, order + 1):
            ends = np.flatnonzero(place >= k - 1)
            pair = self.at[-1][ends - 1] * width + stream[ends]
            by = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], pair[by[1:]] != pair[by[:-1]]))) if len(by) else np.empty(0, np.int64)
            number = np.empty(len(by), np.int64)
            number[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
            whole = np.full(n, -1, np.int64)
            whole[ends] = number
            distinct = pair[by[first]]
            plain = _mix(plain[distinct // width] * _FACTORS[0] + self.hashes[distinct % width] * _FACTORS[1] + np.uint64(k))
            self.at.append(whole)
            self.keys.append(plain)
            self.counts.append(np.bincount(number[trained[ends]], minlength=len(first)).astype(np.uint32))
        self.place = place
        self.by = [np.argsort(x, kind="stable") for x in self.keys]


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers by bytes of equal weight: the high ones repeat and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _ask(order: int, bits: int):
    """Blocks to rows (part of the hash space, block, order, keys, training counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["block"], batch["data"], strict=True):
                block = Block(data.as_py(), order)
                for k in range(order):
                    keys, counts = block.keys[k][block.by[k]], block.counts[k][block.by[k]]
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
                    last = [*first[1:], len(part)]
                    rows = [[part[a], name.as_py(), k + 1, _planes(keys[a:b]), _planes(counts[a:b])] for a, b in zip(first, last, strict=True)]
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["part", "block", "k", "keys", "counts"])

    return run


_ANSWER = "part long, block long, k int, totals binary, tokens long, kinds long"


def _sum(table: pa.Table) -> pa.Table:
    """Totals over all blocks in one part of the hash space, for each block; and the part's tokens and distinct tokens."""
    start = _mix(np.array([xxh3_64_intdigest(START)], np.uint64))[0]
    part, out = table["part"][0].as_py(), []
    for k in sorted(set(table["k"].to_pylist())):
        rows = table.filter(pc.equal(table["k"], k))
        keys = [_from_planes(x, np.uint64) for x in rows["keys"].to_pylist()]
        ends = np.cumsum([len(x) for x in keys])
        keys, counts = np.concatenate(keys), np.concatenate([_from_planes(x, np.uint32) for x in rows["counts"].to_pylist()])
        by = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], keys[by[1:]] != keys[by[:-1]])))
        sums = np.add.reduceat(counts[by].astype(np.int64), first)
        totals = np.empty(len(keys), np.int64)
        totals[by] = np.repeat(sums, np.diff(np.append(first, len(by))))
        inner = (sums > 0) & (keys[by[first]] != start)
        tokens, kinds = (int(sums[inner].sum()), int(inner.sum())) if k == 1 else (0, 0)
        for i, (block, x) in enumerate(zip(rows["block"].to_pylist(), np.split(totals, ends[:-1]), strict=True)):
            out.append((part, block, k, _pack(x), tokens * (i == 0), kinds * (i == 0)))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["part", "block", "k", "totals", "tokens", "kinds"])


CLASSES = 48


def count_class(count: np.ndarray) -> np.ndarray:
    """Counts 1 to 8 by themselves, then by powers of two."""
    big = 5 + np.frexp(np.maximum(count, 1).astype(np.float64))[1]
    return np.where(count <= 8, np.maximum(count, 1) - 1, np.minimum(big - 1, CLASSES - 1)).astype(np.int64)


def _places(block: Block, totals: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of order k + 1: a place where it ends, and its history's total."""
    ends = np.flatnonzero(block.at[k] >= 0)
    some = np.empty(len(totals[k]), np.int64)
    some[block.at[k][ends]] = ends
    before = block.at[k - 1][some - 1]
    return some, totals[k - 1][before] * (before >= 0)


def seen_again(block: Block, totals: list[np.ndarray]) -> np.ndarray:
    """By order and class of the history's count: training tokens, and those of n-grams that occur once."""
    out = np.zeros((len(totals), CLASSES, 2), np.int64)
    for k in range(1, len(totals)):
        _, before = _places(block, totals, k)
        group, own = count_class(before), block.counts[k].astype(np.int64)
        out[k, :, 0] = np.bincount(group, own, CLASSES).astype(np.int64)
        out[k, :, 1] = np.bincount(group, (own == 1) & (totals[k] == 1), CLASSES).astype(np.int64)
    return out


def shares(sums: np.ndarray) -> np.ndarray:
    """s by order and class of c(h), from the sums over all blocks."""
    known = (sums[:, :, 0] - sums[:, :, 1] + 0.05) / (sums[:, :, 0] + 1.0)
    after = count_class(np.concatenate([np.arange(1, 9), 2 ** np.arange(3, CLASSES - 5).astype(np.int64) + 1]) + 1)
    return np.clip(known[:, np.resize(after, CLASSES)], 1e-6, 1 - 1e-6)


def walk(block: Block, totals: list[np.ndarray], tokens: int, kinds: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's base score, score and known tokens."""
    order, inside = len(totals), np.flatnonzero(block.place > 0)
    seen = [t[np.maximum(a, 0)] * (a >= 0) for t, a in zip(totals, block.at, strict=True)]
    root = (totals[0] + 0.5) / (tokens + 0.5 * (kinds + 1))
    base = np.zeros(len(block.place))
    base[inside] = np.log10(root[block.at[0][inside]])
    # Arcs: the probability of an n-gram from that of the shorter one.
    arc = [root]
    for k in range(1, order):
        some, before = _places(block, totals, k)
        shorter, s = arc[k - 1][block.at[k - 1][some]], share[k][count_class(before)]
        arc.append(np.where(before > 0, s * totals[k] / np.maximum(before, 1) + (1 - s) * shorter, shorter))
    # From the longest known state down failure arcs to the first arc that fits.
    score = np.zeros(len(block.place))
    left = inside
    for k in range(order - 1, 0, -1):
        has = block.at[k][left] >= 0
        fits = has & (seen[k][left] > 0)
        hit = left[fits]
        score[hit] += np.log10(arc[k][block.at[k][hit]])
        fails = has & ~fits
        before = seen[k - 1][left[fails] - 1]
        score[left[fails]] += np.where(before > 0, np.log10(1 - share[k][count_class(before)]), 0.0)
        left = left[~fits]
    score[left] += base[left]
    known = np.zeros(len(block.place), np.int64)
    known[inside] = seen[0][inside] > 0
    return tuple(np.add.reduceat(x, block.starts) for x in (base, score, known))


def _gathered(table: pa.Table, order: int) -> tuple[Block, list[np.ndarray]]:
    """A block and the totals of its n-grams, from the rows that have its name."""
    kind, part, data = table["k"].to_numpy(), table["part"].to_numpy(), table["data"].to_pylist()
    block, totals = Block(data[int(np.flatnonzero(kind == 0)[0])], order), []
    for k in range(order):
        at = np.flatnonzero(kind == k + 1)
        whole = np.concatenate([_unpack(data[i], np.int64)[0] for i in at[np.argsort(part[at])]] or [np.empty(0, np.int64)])
        back = np.empty(len(whole), np.int64)
        back[block.by[k]] = whole
        totals.append(back)
    return block, totals


def _tally(order: int):
    def run(table: pa.Table) -> pa.Table:
        sums = seen_again(*_gathered(table, order))
        k, group = np.nonzero(sums[:, :, 0])
        return pa.table([k, group, sums[k, group, 0], sums[k, group, 1]], ["k", "class", "tokens", "once"])

    return run


def _score(order: int, tokens: int, kinds: int, share: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        block, totals = _gathered(table, order)
        base, score, known = walk(block, totals, tokens, kinds, share)
        ids = pa.array(block.ids, mask=~block.known)
        return pa.table(
            [ids, pa.array(~block.train), pa.array(block.lengths.astype(np.int64) - 1), pa.array(known), pa.array(np.full(len(known), tokens)), pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def lm_scores(
    docs: DataFrame, order: int = 2, held_out: int = 1, folds: int = 5, block_bytes: int = 8 << 20, keys_a_part: int = 1 << 20
) -> DataFrame:
    """Scores of every text of ``docs`` (doc_id, text); see the module's docstring.

    Training texts are those whose crc32(doc_id as text) mod ``folds`` is not ``held_out``.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.write(rows.mapInArrow(_blocks(held_out, folds, block_bytes), "block long, tokens long, train_docs long, data binary"), "blocks")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total * order / keys_a_part)))))
    asked = blocks.select("block", "data").mapInArrow(_ask(order, bits), "part long, block long, k int, keys binary, counts binary")
    answers = scratch.write(asked.groupBy("part").applyInArrow(_sum, _ANSWER), "answers")
    sums = answers.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    both = blocks.select("block", F.lit(0).alias("k"), F.lit(0).cast("long").alias("part"), "data").unionByName(
        answers.select("block", "k", "part", F.col("totals").alias("data"))
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    tally = both.groupBy("block").applyInArrow(_tally(order), "k long, class long, tokens long, once long")
    found = np.zeros((order, CLASSES, 2), np.int64)
    for row in tally.groupBy("k", "class").agg(F.sum("tokens").alias("tokens"), F.sum("once").alias("once")).collect():
        found[row.k, row["class"]] = row.tokens, row.once
    return both.groupBy("block").applyInArrow(_score(order, sums.n or 0, sums.v or 0, shares(found)), schema)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
