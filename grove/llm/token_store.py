"""A content-addressed store of token ids.

Texts are encoded with the tokenizers library, one end id is appended to each
document, and the id stream of a document is cut where a rolling hash over the
last 16 ids has its low bits zero, so a change in a text moves few cuts. Each
distinct chunk is stored once under its BLAKE2b digest; a document is a recipe,
an ordered list of digests, and has the Merkle root of that list.

Layout below the store's folder (Parquet files, so any Hadoop store serves):

``chunks/``    digest, n_ids, data: the ids as little-endian unsigned integers
               of 16 bits where the vocabulary allows, else of 32.
``recipes/``   doc_id, part, row, start, n_tokens, root, chunks(digest, n_ids);
               ``part`` and ``start`` rise with doc_id.
``manifest/``  one row: width, end id, documents, tokens and a Merkle root over
               the parts in order. A part's leaf is the SHA-256 of its runs'
               hashes in order, a run's that of its rows' hashes in order, and
               a row's that of its root, doc_id, start and n_tokens.

The store is read back chunk by chunk: each chunk is read and its digest
verified once, however many documents hold it, its length is compared with the
recipes', and a document's CRC-32 is combined from its chunks' by the rule for
concatenated streams.
``read_ids`` rebuilds the ids themselves and checks the same.

Speed: see ``segments``.

Defined results: null and empty texts are the end id alone. Null doc_ids sort
first. Rows that repeat a doc_id are separate documents, in the order of their
roots. A very long text is one row of the encoder and many chunks. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.llm.scratch import Scratch
from grove.llm.segments import WordEncoder, slices
from grove.llm.worker import claim, forgettable

WINDOW, AVERAGE, LEAST, MOST = 16, 1024, 128, 8192
#: Words of each generation that a worker remembers, about 200 bytes each.
REMEMBERED = 700_000


def _joined(tokenizer, dtype: np.dtype):
    """An ``encode`` that hands over many words as one text.

    A word with one space, at its start and before another character, is
    parted from the one before it by the byte-level pattern, and its first id
    is the only one whose bytes start with a space: that is where it starts.
    Others are encoded one by one.
    """
    n = tokenizer.get_vocab_size()
    opens = np.array([(tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(n)])  # the byte-level space
    size = dtype.itemsize

    def alone(part: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype).tobytes() for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def encode(part: list[str]) -> list[bytes]:
        out: list = [None] * len(part)
        at = [i for i, s in enumerate(part) if s.rfind(" ") == 0 and len(s) > 1 and not s[1].isspace()]
        for k in range(0, len(at), 2000):
            some = at[k : k + 2000]
            ids = np.array(tokenizer.encode_batch_fast(["".join([part[i] for i in some])], add_special_tokens=False)[0].ids, dtype)
            starts = np.flatnonzero(opens[ids])
            if len(starts) != len(some) or starts[0]:
                continue  # no byte-level vocabulary
            data, start = ids.tobytes(), 0
            for i, end in zip(some, [*(starts[1:] * size).tolist(), len(data)], strict=True):
                out[i] = data[start:end]
                start = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, alone([part[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return encode


def _added(tokenizer) -> tuple[str, ...]:
    """Strings that are tokens wherever they stand, such as special tokens."""
    return tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())


_encoders: dict[str, tuple[WordEncoder, np.dtype]] = {}
forgettable(_encoders.clear)


def tokenizer_encoder(path: str) -> tuple[WordEncoder, np.dtype]:
    """An encoder of this worker for a tokenizers file; special tokens in texts are ordinary text to none but the file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        _encoders[path] = WordEncoder(_joined(tokenizer, dtype), REMEMBERED, whole=_added(tokenizer)), dtype
    return _encoders[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind ids where the hash of the last 16 has its low bits zero.

    The window doubles: a hash of 2n ids is one of n plus a power times the
    one before it. Documents may follow one another in ``ids``: a chunk has
    more ids than the window, so no cut looks back into another document.
    """
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    width, power = 1, np.uint64(0x9E3779B97F4A7C15)
    while width < WINDOW:
        before = x[:-width] * power
        x = x.copy()
        x[width:] += before
        width, power = 2 * width, np.uint64(int(power) * int(power) % 2**64)
    x ^= x >> np.uint64(29)
    return np.flatnonzero((x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(AVERAGE) == 0) + 1


def cuts(found: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of ``n`` ids with these marks."""
    out, last = [], 0
    for mark in found:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST:
            out.append(mark)
            last = mark
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; a node without a sister moves up as it is."""
    level = digests or [hashlib.blake2b(b"", digest_size=32).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=32).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_CUT = "doc_id long, root binary, seq int, digest binary, n_ids int, data binary"


def _chunked(path: str, end_id: int):
    """Documents to rows of chunks; a digest's data goes with its first chunk of the task alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_store")
        encoder, dtype = tokenizer_encoder(path)
        size = dtype.itemsize
        sent: set[bytes] = set()
        for batch in slices(batches, 1):
            stream, ends = _with_end(encoder(batch.column(1))[0], end_id, dtype)
            data = stream.tobytes()
            places = marks(stream)
            first = 0
            docs, seqs, roots, digests, lengths, parts = [], [], [], [], [], []
            for doc, end, found in zip(batch.column(0).to_pylist(), ends.tolist(), np.split(places, np.searchsorted(places, ends[:-1], "right")), strict=True):
                stops = [0, *cuts((found - first).tolist(), end - first)]
                own = [data[(first + a) * size : (first + b) * size] for a, b in zip(stops, stops[1:])]
                named = [hashlib.blake2b(x, digest_size=32).digest() for x in own]
                docs += [doc] * len(own)
                seqs += range(len(own))
                roots += [merkle_root(named)] * len(own)
                digests += named
                lengths += [len(x) // size for x in own]
                for digest, part in zip(named, own, strict=True):
                    parts.append(None if digest in sent else part)
                    sent.add(digest)
                first = end
            if len(sent) > 1_000_000:
                sent.clear()  # a bound; repeats beyond it are found by the shuffle
            columns = (docs, pa.int64()), (roots, pa.binary()), (seqs, pa.int32()), (digests, pa.binary()), (lengths, pa.int32()), (parts, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["doc_id", "root", "seq", "digest", "n_ids", "data"])

    return run


def _with_end(texts: pa.Array, end_id: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each with the end id, and where each text ends."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) // dtype.itemsize
    ids = np.frombuffer(texts.buffers()[2] or b"", dtype)[bounds[0] : bounds[-1]]
    return np.insert(ids, bounds[1:] - bounds[0], dtype.type(end_id)), bounds[1:] - bounds[0] + np.arange(1, len(texts) + 1)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into a new store at ``path``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    width = width or tokenizer_encoder(tokenizer)[1].itemsize
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_chunked(tokenizer, end_id), _CUT)
    # The row number tells apart rows that repeat an id; it is fixed once written.
    cut = scratch.write(rows.withColumn("at", F.monotonically_increasing_id() - F.col("seq")), "cut")
    # Each task sends a digest's data once, so no digest can crowd one task here; one sort serves both halves of the aggregation.
    spread = cut.filter(F.col("data").isNotNull()).select("digest", "n_ids", "data").repartition("digest")
    spread.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = cut.groupBy("doc_id", "root", "at").agg(
        F.array_sort(F.collect_list(F.struct("seq", "digest", "n_ids"))).alias("c"), F.sum("n_ids").cast("long").alias("n_tokens")
    )
    recipes = recipes.select("doc_id", "root", "at", "n_tokens", F.transform("c", lambda x: F.struct(x["digest"], x["n_ids"])).alias("chunks"))
    sorted_ = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("at"))
    parts = scratch.write(sorted_.withColumn("part", F.spark_partition_id()), "parts")
    # One row for each range partition comes to the driver.
    before, offsets = 0, []
    for part, n in parts.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():
        offsets.append((part, before))
        before += n
    known = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root", "at")
    (
        parts.join(known, "part")
        .withColumn("row", F.row_number().over(order))
        .withColumn("start", F.col("before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .select("part", "row", "doc_id", "start", "n_tokens", "root", "chunks")
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    scratch.drop("cut", "parts")
    documents, root = _manifest_root(spark.read.parquet(f"{path}/recipes"))
    spark.createDataFrame([(width, end_id, documents, before, root)], "width int, end_id int, documents long, tokens long, root binary").coalesce(
        1
    ).write.parquet(f"{path}/manifest")


#: Recipes of a run, whose hashes one row of an aggregation holds.
RUN = 4096


def _manifest_root(recipes: DataFrame) -> tuple[int, bytes]:
    """Number of recipes and their Merkle root; one row a part reaches the driver."""

    def in_order(at: str, what: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), what.alias("hash"))))
        return F.sha2(F.array_join(F.transform(rows, lambda x: x["hash"]), ""), 256)

    own = F.sha2(F.concat_ws(":", F.hex("root"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens"), 256)
    run = F.floor((F.col("row") - 1) / RUN).cast("long")
    runs = recipes.groupBy("part", run.alias("run")).agg(in_order("row", own).alias("hash"), F.count(F.lit(1)).alias("n"))
    parts = runs.groupBy("part").agg(in_order("run", F.col("hash")).alias("hash"), F.sum("n").alias("n")).orderBy("part").collect()
    return sum(x.n for x in parts), merkle_root([bytes.fromhex(x.hash) for x in parts])


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes are those that the manifest was made from."""
    kept = spark.read.parquet(f"{path}/manifest").first()
    if _manifest_root(spark.read.parquet(f"{path}/recipes")) != (kept.documents, kept.root):
        raise ValueError(f"the recipes in {path} do not match its manifest")


# CRC-32 of concatenated streams: crc(a + b) = crc(a) * x^(8 len b) + crc(b), polynomials over GF(2).
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


_shifts: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x^(8 n_bytes)."""
    if n_bytes not in _shifts:
        out, power, n = 1 << 31, 1 << 30, 8 * n_bytes
        while n:
            if n & 1:
                out = _times(power, out)
            power, n = _times(power, power), n >> 1
        if len(_shifts) > 100_000:
            _shifts.clear()
        _shifts[n_bytes] = out
    return _shifts[n_bytes]


def combine_crc(first: int, second: int, second_bytes: int) -> int:
    return _times(_shift(second_bytes), first) ^ second


def _chunk_sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, lengths = [], []
            for digest, data in zip(batch["digest"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if hashlib.blake2b(data, digest_size=32).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                sums.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
                lengths.append(len(data) // width)
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(sums, pa.int64()), pa.array(lengths, pa.int32())], ["digest", "crc", "length"])

    return run


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for root, n_tokens, parts in zip(*(batch[c].to_pylist() for c in ("root", "n_tokens", "parts")), strict=True):
            if merkle_root([x["digest"] for x in parts]) != root or sum(x["n_ids"] for x in parts) != n_tokens or any(x["n_ids"] != x["length"] for x in parts):
                raise ValueError(f"a recipe with root {root.hex()} is damaged")
            crc = 0
            for x in parts:
                crc = combine_crc(crc, x["crc"], 4 * x["n_ids"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def _recipe_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "part", "row", "start", "n_tokens", "root", F.posexplode("chunks").alias("seq", "chunk"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document, from the store's verified chunks."""
    verify_manifest(spark, path)
    width = spark.read.parquet(f"{path}/manifest").first().width
    sums = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(_chunk_sums(width), "digest binary, crc long, length int")
    rows = _recipe_rows(spark, path).withColumn("digest", F.col("chunk.digest"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "digest", F.col("chunk.n_ids").alias("n_ids"), "crc", "length"))).alias("parts")
    whole = rows.join(sums, "digest", "left").groupBy("part", "row", "doc_id", "start", "n_tokens", "root").agg(parts)
    return whole.mapInArrow(_document_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of each document, from verified chunks; a missing or damaged one raises."""
    verify_manifest(spark, path)
    width = spark.read.parquet(f"{path}/manifest").first().width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, n_tokens, parts in zip(*(batch[c].to_pylist() for c in ("root", "n_tokens", "parts")), strict=True):
                data = [x["data"] for x in parts]
                if None in data or merkle_root([hashlib.blake2b(x, digest_size=32).digest() for x in data]) != root:
                    raise ValueError(f"a chunk of the recipe with root {root.hex()} is damaged or missing")
                out.append(np.frombuffer(b"".join(data), f"<u{width}").astype(np.int32))
                if len(out[-1]) != n_tokens:
                    raise ValueError(f"a recipe with root {root.hex()} is damaged")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    rows = _recipe_rows(spark, path).withColumn("digest", F.col("chunk.digest"))
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data")
    parts = F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts")
    whole = rows.join(chunks, "digest", "left").groupBy("part", "row", "doc_id", "start", "n_tokens", "root").agg(parts)
    return whole.mapInArrow(run, "doc_id long, start long, ids array<int>")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "store").path("store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(spark, path)
