"""Exact dedup through a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest. A batch is
reduced to one row per digest (partial aggregation first, so a group of
copies never meets in one task as rows), deduplicated against the index by a
sort-merge anti-join that reads the index without a shuffle, and what is new
is appended. Only digests, ids and lengths are shuffled, never texts.

Defined results: a null text counts as empty, and all empty texts are one
group. Of equal texts the longest original stays, then the smallest doc_id
(null ids last). Rows that repeat a doc_id with an equal text share one
decision. A very long text is one row, of which a digest is kept. Extra columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.scratch import Scratch

#: The characters that normalisation deletes: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text in UTF-8 without ASCII white space."""
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), "UTF-8"), 256)


class DigestIndex:
    """A persistent set of text digests, one bucketed table in the warehouse."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, n_chars BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "n_chars")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Rewrite the index as one sorted file a bucket, after many appends."""
        swap = f"{self.name}_compact_{uuid.uuid4().hex}"
        old = self.table()
        # As plain files, dealt anew: one task writes a bucket.
        files = old.inputFiles()
        DigestIndex(self.spark, swap, self.buckets).append(self.spark.read.schema(old.schema).parquet(*files) if files else old)
        self.drop()
        self.spark.sql(f"ALTER TABLE {swap} RENAME TO {self.name}")
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Decide on a batch and append its new digests.

        Returns doc_id, keep_id, group_size (rows of this batch with that
        digest), kept, text_sha256. A text that an earlier batch brought is
        dropped in favour of that batch's document.
        """
        scratch = Scratch(self.spark, "dedup")
        text = F.coalesce(F.col("text"), F.lit(""))
        digests = scratch.write(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.unhex(text_digest(F.col("text"))).alias("digest"),
                F.length(text).cast("long").alias("n_chars"),
            ),
            "digests",
        )
        first = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))
        groups = scratch.write(
            digests.groupBy("digest")
            .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.col1")).alias("n_chars"), "group_size"),
            "groups",
        )
        known = self.table()
        fresh = groups.hint("merge").join(known, "digest", "left_anti").withColumn("fresh", F.lit(True))
        old = groups.drop("keep_id", "n_chars").hint("merge").join(known, "digest").withColumn("fresh", F.lit(False))
        columns = ["digest", "keep_id", "n_chars", "group_size", "fresh"]
        decided = scratch.write(fresh.select(columns).unionByName(old.select(columns)), "decided")
        self.append(decided.filter("fresh"))
        return digests.join(decided.drop("n_chars"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("fresh")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


#: Digests of a bucket, 60 bytes each.
BUCKET_ROWS = 2_000_000


def buckets_for(docs: DataFrame) -> int:
    """A power of two, so that an index of this table's size has at most ``BUCKET_ROWS`` digests a bucket in the mean; 8 at least."""
    return max(8, 1 << max(0, -(-docs.count() // BUCKET_ROWS) - 1).bit_length())


def exact_dedup(docs: DataFrame, index: str | None = None, buckets: int | None = None) -> DataFrame:
    """Deduplicate one table against ``index``, or against a new index of its own, which goes when it has served.

    ``buckets`` of a new index follow from the table's rows unless they are given.
    """
    own = DigestIndex(docs.sparkSession, index or f"digest_index_{uuid.uuid4().hex}", buckets or buckets_for(docs))
    out = own.add(docs)
    if index is None:
        own.drop()
    return out


def keep_first_copies(docs: DataFrame, index: str | None = None, buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay; a row repeated with the same id and text stays once."""
    kept = (
        exact_dedup(docs.select("doc_id", "text"), index, buckets)
        .filter("kept")
        .select("doc_id", "text_sha256")
        .distinct()
    )
    key = "_sha256"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, text_digest(F.col("text")))
    same = keyed["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (keyed[key] == kept["text_sha256"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


QUERY_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
