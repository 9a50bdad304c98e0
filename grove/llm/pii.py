"""Personal data: fixed patterns, and bootstrapped contexts that find what they miss.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone
numbers in whole texts by fixed patterns, leftmost and without overlap, each
kind by itself. Its finds are the seeds. A context is the word before or after
an identifier of a kind. Contexts and instances form a graph that Spark scores
in rounds: a context's confidence is the weight of the instances in it over
*all* occurrences of its word in the corpus, by itself or glued to others (the
"tel:" of "tel:none", the ")" of "see)"), an instance's weight is 1 for a
seed and else 1 - product of (1 - confidence) over its contexts. Contexts need
``support`` different seeds. What only looks like an identifier (a number that
fails its checksum, a phone number without plus, a written-out address, an
IPv6 address) is added when its weight reaches ``accept``; base spans stay.

Nothing of the corpus is held by one task: instances and word counts are
tables, aggregated by key, and texts are never shuffled.

Defined results: null and empty texts have no spans. Added spans overlap no
base span, and of overlapping ones the leftmost, then longest, stays. Rows are
independent but for the counts; rows that repeat a doc_id have a result each.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits has one place to start a match: its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNAL = re.compile(r"[0-9@]")
#: What only looks like an identifier.
_LIKE = (
    (0, re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![\w.+-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\w-])")),
    (3, re.compile(r"(?<![\w.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![\w-])")),
)
#: Where a word's beginning ends before what could be an identifier, and its end begins after; of 60 characters at most, as contexts are.
_GLUE_BEFORE = re.compile(r"(?<!.{60})[^\w](?=[\w+(])")
_GLUE_AFTER = re.compile(r"\w(?=[^\w].{0,59}$)", re.S)
_SPAN = "struct<kind:int,start:int,stop:int>"
_ROW = f"doc_id long, base array<{_SPAN}>, seen array<struct<kind:int,start:int,stop:int,seed:boolean,value:string,before:string,after:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their "@"; linear in the text."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            least = found.end()
            yield start, least
        at = text.find("@", max(at + 1, least))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by start, then kind."""
    if not _SIGNAL.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def likely_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What looks like an identifier and overlaps no base span."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    found = sorted(((k, *m.span()) for k, pattern in _LIKE for m in pattern.finditer(text)), key=lambda x: (x[1], -x[2], x[0]))
    i, last = 0, 0
    for kind, a, b in found:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            out.append((kind, a, b))
            last = b
    return out


def words(text: str) -> list[str]:
    """Words for contexts: lower case, digits as 0, so that a number is no word of its own."""
    return re.sub(r"[0-9]+", "0", text.lower()).split()


def _contexts(text: str, start: int, stop: int) -> tuple[str | None, str | None]:
    """The words that touch a span, with what is glued to it."""
    before = after = None
    size = 64
    while before is None or after is None:  # until a word's other end is in sight, or the text's
        if before is None and (len(found := text[max(0, start - size) : start].split()) > 1 or start <= size):
            before = words(found[-1])[0] if found else ""
        if after is None and (len(found := text[stop : stop + size].split()) > 1 or stop + size >= len(text)):
            after = words(found[0])[0] if found else ""
        size *= 4
    return before or None, after or None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    seen = pa.struct([*span, ("seed", pa.bool_()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())])
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            bases, all_seen = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                like = likely_spans(text, base) if _SIGNAL.search(text) or "at" in text else []
                bases.append([dict(zip(("kind", "start", "stop"), x, strict=True)) for x in base])
                rows = []
                for seed, spans in ((True, base), (False, like)):
                    for kind, a, b in spans:
                        before, after = _contexts(text, a, b)
                        value = hashlib.blake2b(text[a:b].encode(), digest_size=8).hexdigest()
                        rows.append({"kind": kind, "start": a, "stop": b, "seed": seed, "value": value, "before": before, "after": after})
                all_seen.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(all_seen, pa.list_(seen))], ["doc_id", "base", "seen"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, of their beginnings and of their ends where an identifier could be glued; summed within the task up to a bound of different words."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        heads, tails = Counter(), Counter()
        for word, n in counts.items():
            if not word.isalnum():
                for m in _GLUE_BEFORE.finditer(word):
                    heads[word[: m.end()]] += n
                for m in _GLUE_AFTER.finditer(word):
                    tails[word[m.end() :]] += n
        every = list(dict.fromkeys([*counts, *heads, *tails]))
        out = [pa.array([c[x] for x in every], pa.int64()) for c in (counts, heads, tails)]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *out], ["word", "n", "before", "after"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text or ""))
            if len(counts) > 500_000:
                yield rows()
    yield rows()


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for base, more in zip(batch["base"].to_pylist(), batch["more"].to_pylist(), strict=True):
            base, more = ([(x["kind"], x["start"], x["stop"]) for x in y or ()] for y in (base, more))
            for i in range(4):
                columns[i].append(sum(k == i for k, _, _ in base))
            columns[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            columns[5].append(_joined(sorted(base + more, key=lambda x: (x[1], x[0], x[2]))))
            columns[6].append(len(more))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
        )


def find_pii(docs: DataFrame, rounds: int = 3, support: int = 5, accept: float = 0.8) -> DataFrame:
    """Spans of personal data in every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = scratch.write(docs.mapInArrow(_scan, _ROW).withColumn("row", F.monotonically_increasing_id()), "scanned")
    seen = scanned.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    sides = [seen.select("row", "kind", "start", "stop", "seed", "value", F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("before", "after")]
    edges = sides[0].unionByName(sides[1]).filter("word is not null")
    # Contexts that different seeds share; all others can have no confidence.
    keys = ["kind", "side", "word"]
    shared = edges.filter("seed").groupBy(*keys).agg(F.count_distinct("value").alias("seeds")).filter(F.col("seeds") >= support)
    shared = scratch.write(shared, "shared")
    if shared.limit(1).count():
        counted = docs.select("text").mapInArrow(_count_words, "word string, n long, before long, after long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "before", "after")))
        # What touches identifiers and what looks like them is there, however it is glued.
        touching = edges.groupBy("side", "word").agg(F.count(F.lit(1)).alias("touching"))
        glued = F.when(F.col("side") == "before", F.col("before")).otherwise(F.col("after"))
        n = F.greatest(F.coalesce(F.col("n") + glued, F.lit(0)), "touching").alias("n")
        contexts = scratch.write(shared.join(counted, "word", "left").join(touching, ["side", "word"]).select(*keys, n), "contexts")
        edges = scratch.write(edges.join(contexts, keys), "edges")
        found = ["row", "kind", "start", "stop"]
        weights = None
        for turn in range(rounds):
            now = edges.withColumn("weight", F.col("seed").cast("double"))
            if weights is not None:
                now = edges.join(weights, found, "left").withColumn("weight", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("w", F.lit(0.0))))
            # Never above 1.
            sure = now.groupBy(*keys, "n").agg(F.sum("weight").alias("sum")).select(*keys, F.least(F.col("sum") / F.greatest("n", "sum"), F.lit(0.999999)).alias("c"))
            weights = edges.filter("not seed").join(sure, keys).groupBy(*found).agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("w"))
            weights = scratch.write(weights, f"weights-{turn}")
        more = weights.filter(F.col("w") >= accept).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("more"))
        rows = scanned.select("row", "doc_id", "base").join(more, "row", "left")
    else:
        rows = scanned.select("row", "doc_id", "base", F.lit(None).cast(f"array<{_SPAN}>").alias("more"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return rows.select("doc_id", "base", "more").mapInArrow(_result, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
