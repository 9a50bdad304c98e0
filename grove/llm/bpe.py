"""Byte-level BPE encoding and decoding in DuckDB, one database per worker.

A text is cut into words (``segments``), a word into matches of the pattern,
and a match, when it is no token itself, starts as rows (word,
position, token), one a byte. Each round of a recursive query joins rows of
token and position with the merge table, contracts each word's leftmost pair
of least rank (in a long word all places of that pair), and ends when no pair
of a word can merge. Decoding joins ids with the
vocabulary and aggregates the bytes in order of position. Only words that
the worker has not seen lately go through DuckDB; its memory is limited.

The merge table has a row for each way to split a token into two tokens, which
is what "merge a pair if its bytes are a token" means for a rank file.

Defined results: null and empty texts have no ids and decode to no bytes.
Rows are independent: nulls, ties and repeated rows need no rule. A very long
text is one row; a match of very many bytes takes as many rounds as it has
merges of different rank, and memory in proportion to its length. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.segments import WordEncoder, slices
from grove.llm.worker import claim, forgettable, rest

#: A word's tokens are a list between rounds. Pair of tokens as one key; rank and place as one number that sorts by rank, then place.
ENCODE_SQL = """
WITH RECURSIVE state AS (
  SELECT word, list(tok ORDER BY pos) AS toks, 0 AS turn FROM start GROUP BY word
  UNION ALL
  SELECT word, toks[:place - 1] || [merged] || toks[place + 2:], turn + 1 FROM (
    SELECT word, any_value(toks) AS toks, any_value(turn) AS turn, min(m.merged::BIGINT * 4294967296 + spot) AS best,
           (best % 4294967296)::INT AS place, (best // 4294967296)::INT AS merged
    FROM (SELECT word, toks, turn, unnest(range(1, len(toks))) AS spot, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS nxt FROM state WHERE len(toks) > 1) s
    JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.nxt
    GROUP BY word))
SELECT word, arg_max(toks, turn) AS toks FROM state GROUP BY word ORDER BY word
"""
#: Long words: a round contracts all places of a word's pair of least rank, and only a word's last state is kept. Where the merged token
#: could merge with a neighbour at a lower rank still (a ``bad`` pair), only the leftmost place is contracted.
LONG_SQL = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, list(tok ORDER BY pos) AS toks FROM start GROUP BY word
  UNION
  SELECT word, list(coalesce(merged, tok) ORDER BY spot) AS toks FROM (
    SELECT s.word, s.spot, s.tok, c.merged, lag(c.merged) OVER (PARTITION BY s.word ORDER BY s.spot) AS taken
    FROM (SELECT word, generate_subscripts(toks, 1) AS spot, unnest(toks) AS tok FROM state) s
    LEFT JOIN (
      SELECT word, spot, merged FROM (
        SELECT word, spot, merged, safe, row_number() OVER (PARTITION BY word ORDER BY spot) AS nth,
               row_number() OVER (PARTITION BY word, island ORDER BY spot) AS place
        FROM (SELECT word, spot, f.merged, spot - row_number() OVER (PARTITION BY word ORDER BY spot) AS island,
                     bool_and(x.pair IS NULL AND y.pair IS NULL AND z.pair IS NULL) OVER (PARTITION BY word) AS safe
              FROM (SELECT word, spot, prv, nx2, m.merged, min(m.merged) OVER (PARTITION BY word) AS best
                    FROM (SELECT word, unnest(range(1, len(toks))) AS spot, unnest([NULL] || toks[:-3]) AS prv, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS nxt,
                                 unnest(toks[3:] || [NULL]) AS nx2 FROM state WHERE len(toks) > 1) p
                    JOIN merges m ON m.pair = p.tok::BIGINT * 4294967296 + p.nxt) f
              LEFT JOIN bad x ON x.pair = f.merged::BIGINT * 4294967296 + f.nx2
              LEFT JOIN bad y ON y.pair = f.prv::BIGINT * 4294967296 + f.merged
              LEFT JOIN bad z ON z.pair = f.merged::BIGINT * 4294967296 + f.merged
              WHERE f.merged = best))
      WHERE CASE WHEN safe THEN place % 2 = 1 ELSE nth = 1 END) c ON c.word = s.word AND c.spot = s.spot
    WHERE s.word IN (
      SELECT word FROM (SELECT word, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS nxt FROM state) p
      JOIN merges m ON m.pair = p.tok::BIGINT * 4294967296 + p.nxt))
  WHERE taken IS NULL GROUP BY word)
SELECT word, toks FROM state ORDER BY word
"""
#: Bytes from which on a word is long.
LONG = 64
DECODE_SQL = """
SELECT word, string_agg(hex, '' ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (tok) GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class DuckBpe:
    """Vocabulary, merge table and queries of one rank file."""

    def __init__(self, path: str, pattern: str, memory: str = "100MB"):
        import duckdb
        import regex

        self.ranks = ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": "", "allocator_flush_threshold": "16MB"})
        pairs = np.array(left, np.int64) * 2**32 + np.array(right, np.int64)
        self.db.register("pairs", pa.table({"pair": pairs, "merged": np.array(merged, np.int32)}))
        self.db.execute("CREATE TABLE merges AS FROM pairs ORDER BY pair")
        # Pairs that merge at a lower rank than one of their own tokens has.
        self.db.execute("CREATE TABLE bad AS SELECT pair FROM merges WHERE merged < greatest(pair // 4294967296, pair % 4294967296)")
        self.db.register("named", pa.table({"tok": np.fromiter(ranks.values(), np.int32), "hex": [x.hex() for x in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS FROM named ORDER BY tok")

    def _run(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each word has, of byte strings that are not tokens themselves."""
        lengths = np.array([len(x) for x in words], np.int64)
        start = {"word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": _within(lengths).astype(np.int32)}
        start["tok"] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        found = self._run(LONG_SQL if max(map(len, words)) >= LONG else ENCODE_SQL, start=pa.table(start))["toks"].combine_chunks()
        return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each word has, of byte strings; one that is a token is that token."""
        known = np.array([self.ranks.get(x, -1) for x in words], np.int64)
        new = np.flatnonzero(known < 0)
        long = np.array([len(words[i]) >= LONG for i in new], bool)
        new = new[np.argsort(long, kind="stable")]
        groups = [r[at : at + most] for r, most in ((new[: len(new) - long.sum()], 10_000), (new[len(new) - long.sum() :], 200)) for at in range(0, len(r), most)]
        parts = [self.words([words[i] for i in group]) for group in groups]
        lengths = np.ones(len(words), np.int64)
        if parts:
            lengths[new] = np.concatenate([n for _, n in parts])
        starts, ids = np.cumsum(lengths) - lengths, np.empty(lengths.sum(), np.int32)
        ids[starts[known >= 0]] = known[known >= 0]
        if parts:
            ids[np.repeat(starts[new], lengths[new]) + _within(lengths[new])] = np.concatenate([x for x, _ in parts])
        return ids, lengths

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each of the id sequences that follow one another in ``ids``."""
        tokens = {"word": np.repeat(np.arange(len(lengths), dtype=np.int64), lengths), "pos": _within(lengths), "tok": ids.astype(np.int32)}
        out = [b""] * len(lengths)
        table = self._run(DECODE_SQL, tokens=pa.table(tokens))
        for word, text in zip(table["word"].to_pylist(), table["bytes"].to_pylist(), strict=True):
            out[word] = bytes.fromhex(text)
        return out


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class _RoundTrip(WordEncoder):
    """The ids of texts, and the bytes that those ids decode to, word by word."""

    def __init__(self, bpe: DuckBpe, limit: int):
        super().__init__(self._encoded, limit, pairs=True)
        self.bpe = bpe

    def matches(self, word: str) -> list[str]:
        """The pattern's matches; letters, after a space or not, need no search."""
        return [word] if word.removeprefix(" ").isalpha() else self.bpe.pattern.findall(word)

    def _encoded(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        cut = [self.matches(x) for x in words]
        distinct = list(set().union(*cut))
        ids, lengths = self.bpe.encode([x.encode() for x in distinct])
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
        known = dict(zip(distinct, zip(pieces, self.bpe.decode(ids, lengths), strict=True), strict=True))
        return [known[x[0]] if len(x) == 1 else (b"".join([known[y][0] for y in x]), b"".join([known[y][1] for y in x])) for x in cut]


_bpes: dict[tuple[str, str, int], _RoundTrip] = {}
forgettable(_bpes.clear)


#: Words of each generation that a worker remembers: about 320 bytes each.
REMEMBERED = 300_000


def _round_trip(path: str, pattern: str, remembered: int = REMEMBERED) -> _RoundTrip:
    """This worker's encoder; what it remembers outlives a task."""
    claim("bpe")
    key = path, pattern, remembered
    if key not in _bpes:
        _bpes[key] = _RoundTrip(DuckBpe(path, pattern), remembered)
    return _bpes[key]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the bytes that the ids decode to.

    A worker remembers up to ``remembered`` words of each generation; fewer
    take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _round_trip(ranks, pattern, remembered)
        for batch in slices(batches, 1):
            ids, texts = bpe(batch.column(1))
            counts = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, ids, texts], ["doc_id", "n_tokens", "ids", "decoded"])
        rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def decode(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids (little-endian unsigned 32-bit); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _round_trip(ranks, pattern).bpe
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                ids = batch.column(1).to_pylist()
                flat = np.frombuffer(b"".join(x or b"" for x in ids), "<u4")
                texts = bpe.decode(flat, np.array([len(x or b"") // 4 for x in ids], np.int64))
                texts = [None if x is None else y.decode("utf-8", "replace") for x, y in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and the columns in ``more``."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def production_encoder() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *production_encoder()))
