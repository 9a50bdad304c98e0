"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: densities of a fixed and of a learned lexicon, how
near their words stand to second-person words, shares of capitals, shouted
words, punctuation and exclamation marks, obfuscated spellings, lengths.

Fitting uses a bounded sample of the labelled training documents
(``sample_rows``, the smallest hashes of doc_id), in three parts by hash: one
learns the lexicon (words and word beginnings that are common in toxic texts
and rare in others), one the trees, one the calibration. Term counts are made
on executors; only the terms that pass the support threshold, features and
labels of the sample reach the driver. Scoring is one pass over all texts with
no shuffle.

Defined results: null and empty texts are scored from zero features. Labels
that are null, and labels of unknown documents, are ignored; of several labels
of a document the largest counts. Without a toxic and a clean label to learn
from, every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.boosting import Boosted, boost, isotonic
from grove.llm.scratch import Scratch
from grove.llm.worker import claim, rest

#: Common insults, kept short; the rest is learned.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown clowns pathetic worthless disgusting "
    "filth filthy fool fools imbecile vermin pig pigs rat rats bastard bitch whore slut dick asshole shit fuck fucking "
    "fucker crap retard retarded jerk creep ugly lunatic psycho coward cowards liar cretin dimwit "
    "dummkopf arschloch scheiße wichser hurensohn abschaum connard salaud putain merde imbécile ordure "
    "gilipollas idiota estúpido imbécil mierda cabrón puta basura".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur youre you're ya du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton tes vous votre vos tú ti usted ustedes vosotros".split()
)
#: Characters that stand for letters in obfuscated spellings.
LEET = str.maketrans("013457@$!|+", "oieastasilt")
PREFIXES = range(4, 8)
NEAR = 5
#: Columns of what is known of a word.
INSULT, LEARNED, SECOND, HIDDEN, MIXED, UPPER, LETTERS, MARKS, BANGS, DIGITS, SHOUT, LENGTH, STRETCHED = range(13)
FEATURES = 19


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    prefixes: frozenset = frozenset()

    def has(self, core: str) -> bool:
        return core in self.words or any(core[:n] in self.prefixes for n in PREFIXES if len(core) >= n)


def core_of(word: str) -> str:
    """Lower case, without what isn't a letter at either end."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


class WordTable(dict):
    """Rows of numbers about words, remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.rows = np.zeros((1024, 13), np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        core = core_of(word)
        row = self.rows[at]
        row[INSULT], row[LEARNED], row[SECOND] = core in INSULTS, self.lexicon.has(core), core in SECOND_PERSON
        letters = sum(map(str.isalpha, word))
        row[LETTERS], row[DIGITS], row[LENGTH] = letters, sum(map(str.isdigit, word)), len(word)
        row[MARKS], row[BANGS] = len(word) - letters - row[DIGITS], word.count("!")
        row[UPPER] = sum(map(str.isupper, word))
        row[SHOUT] = letters > 1 and row[UPPER] == letters
        if core and not core.isalpha():
            row[MIXED] = 1
            plain = "".join(filter(str.isalpha, core.translate(LEET)))
            row[HIDDEN] = plain in INSULTS or self.lexicon.has(plain)
        if len(core) > 3 and any(a == b == c for a, b, c in zip(core, core[1:], core[2:])):
            row[STRETCHED] = 1
            plain = "".join(c for i, c in enumerate(core) if not i or c != core[i - 1])
            row[HIDDEN] |= plain in INSULTS or self.lexicon.has(plain)
        self[word] = at
        return at

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(FEATURES)
        words = text.split()
        n = len(words)
        if not n:
            return out
        if len(self) > self.LIMIT:
            self.clear()
            self.rows = np.zeros((1024, 13), np.int32)
        ids = np.fromiter(map(self.__getitem__, words), np.intp, n)
        rows = self.rows[ids]
        total = rows.sum(axis=0, dtype=np.float64)
        hit = (rows[:, INSULT] | rows[:, LEARNED] | rows[:, HIDDEN]) > 0
        out[0:4] = total[INSULT] / n, total[LEARNED] / n, total[HIDDEN] / n, hit.sum() / n
        out[4:7] = min(total[INSULT], 20), min(total[LEARNED], 20), min(hit.sum(), 20)
        if hit.any():
            you = np.flatnonzero(rows[:, SECOND])
            if len(you):
                at = np.flatnonzero(hit)
                k = np.searchsorted(you, at)
                gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
                out[7] = (gap <= NEAR).mean()
        out[8] = total[SECOND] / n
        letters, length = max(total[LETTERS], 1), max(total[LENGTH], 1)
        out[9:15] = total[UPPER] / letters, total[SHOUT] / n, total[MARKS] / length, total[BANGS] / length, total[DIGITS] / length, total[MIXED] / n
        out[15:19] = total[STRETCHED] / n, np.log1p(n), total[LETTERS] / n, total[HIDDEN]
        return out


def terms(text: str) -> set[str]:
    """Distinct words ("=...") and word beginnings ("^...") of a text."""
    out = set()
    for word in set(text.split()):
        core = core_of(word)
        if len(core) > 1:
            out.add("=" + core)
            out.update("^" + core[:n] for n in PREFIXES if len(core) >= n)
    return out


def _term_counts(only: frozenset | None):
    """(term, toxic documents, clean documents) of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = terms(text or "")
                counts[bool(label)].update(found if only is None else found & only)
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            ["term", "toxic", "clean"],
        )

    return run


@dataclass
class ToxicityModel:
    lexicon: Lexicon = field(default_factory=Lexicon)
    trees: Boosted | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the plain one keeps the order within a step."""
        if self.trees is None:
            return np.zeros(len(x))
        raw = self.trees(x)
        plain = 1 / (1 + np.exp(-raw))
        if self.knots is None:
            return plain
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * plain, 0, 1)


def training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, support: float = 0.02, ratio: float = 30.0) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out fifth.

    A term enters the lexicon if it stands in at least ``support`` of the toxic
    texts (and 4 of them) and is ``ratio`` times as common there as in clean ones.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(order, "doc_id")
        .limit(sample_rows)
    )
    # The sample's ids are at most sample_rows rows: the bound that makes this broadcast safe.
    sample = scratch.write(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(20))),
        "sample",
    )
    sizes = {r.toxic > 0: r.n for r in sample.filter("part < 9").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = Lexicon()
    if len(sizes) == 2:
        first = sample.filter("part < 9").select("text", "toxic")
        schema = "term string, toxic long, clean long"
        least = max(4, support * sizes[True])
        common = first.filter("toxic > 0").mapInArrow(_term_counts(None), schema).groupBy("term").agg(F.sum("toxic").alias("toxic"))
        toxic = {r.term: r.toxic for r in common.filter(F.col("toxic") >= least).collect()}
        rare = first.filter("toxic = 0").mapInArrow(_term_counts(frozenset(toxic)), schema).groupBy("term").agg(F.sum("clean").alias("clean"))
        clean = {r.term: r.clean for r in rare.collect()}
        rate = lambda t: (toxic[t] / sizes[True]) / ((clean.get(t, 0) + 0.5) / sizes[False])
        chosen = [t for t in toxic if rate(t) >= ratio]
        lexicon = Lexicon(frozenset(t[1:] for t in chosen if t[0] == "="), frozenset(t[1:] for t in chosen if t[0] == "^"))
    rows = sample.filter("part >= 9").mapInArrow(_featured(lexicon), "toxic int, part long, x array<double>").collect()
    model = ToxicityModel(lexicon)
    x, y, part = np.array([r.x for r in rows]), np.array([r.toxic > 0 for r in rows], float), np.array([r.part for r in rows])
    fits = part < 16 if len(rows) else part
    if len(rows) and 0 < y[fits].sum() < fits.sum():
        model.trees = boost(x[fits], y[fits])
        rest = ~fits
        if rest.sum() >= 200 and 0 < y[rest].sum() < rest.sum():
            model.knots = isotonic(model.trees(x[rest]), y[rest])
    scratch.drop("sample")
    return model


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        table = WordTable(lexicon)
        for batch in batches:
            x = [table.features(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], batch["part"], pa.array(x, pa.list_(pa.float64()))], ["toxic", "part", "x"])

    return run


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        table = WordTable(model.lexicon)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                x = np.stack([table.features(t or "") for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not take for toxic; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        table = WordTable(model.lexicon)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                x = np.stack([table.features(t or "") for t in batch["text"].to_pylist()])
                yield batch.filter(pa.array(model.score(x) < 0.5))
        del table
        rest()

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
