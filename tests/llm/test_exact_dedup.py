import hashlib
import re
import uuid
from collections import defaultdict

from samples import texts

from pyspark.sql import functions as F

import grove.llm.exact_dedup as exact_dedup_module
from grove.llm.exact_dedup import DigestIndex, exact_dedup, keep_first_copies


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected():
    groups = defaultdict(list)
    for i, t in texts():
        groups[bare(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in texts():
        group = groups[bare(t)]
        keep = min(group, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs):
    got = [tuple(r) for r in exact_dedup(docs, buckets=4).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == expected()


def test_empty(no_docs):
    assert exact_dedup(no_docs, buckets=2).count() == 0
    assert keep_first_copies(no_docs, buckets=2).columns == no_docs.columns


def test_one_row_of_each_text_stays(docs):
    kept = keep_first_copies(docs, buckets=4)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len({bare(t) for _, t in texts()})
    assert {bare(r.text) for r in rows} == {bare(t) for _, t in texts()}


def test_index_persists(spark):
    index = DigestIndex(spark, f"idx_{uuid.uuid4().hex}", 4)
    first = index.add(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")).collect()
    assert all(r.kept for r in first)
    again = DigestIndex(spark, index.name, 4)
    second = {r.doc_id: r for r in again.add(spark.createDataFrame([(1, "ab"), (7, "d"), (8, "d ")], "doc_id long, text string")).collect()}
    assert (second[1].kept, second[1].keep_id) == (False, 5)
    assert (second[8].kept, second[7].kept, second[7].keep_id, second[7].group_size) == (True, False, 8, 2)
    assert again.table().count() == 3


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = DigestIndex(spark, f"idx_{uuid.uuid4().hex}", 4)
    index.add(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")).count()
    groups = spark.range(100).select(F.unhex(F.sha2(F.encode(F.concat(F.lit("t"), F.col("id").cast("string")), "UTF-8"), 256)).alias("digest"))
    fresh = groups.hint("merge").join(index.table(), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Range") < plan.index("FileScan")
    assert fresh.count() == 50


def test_index_is_compacted_and_dropped(spark):
    index = DigestIndex(spark, f"idx_{uuid.uuid4().hex}", 2)
    for at in range(3):
        index.add(spark.createDataFrame([(i, f"t{i}") for i in range(10 * at, 10 * at + 20)], "doc_id long, text string")).count()
    before = sorted(map(str, index.table().collect()))
    index.compact()
    assert sorted(map(str, index.table().collect())) == before and len(index.table().inputFiles()) <= 2
    assert index.add(spark.createDataFrame([(99, "t0"), (100, "new")], "doc_id long, text string")).filter("kept").count() == 1
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_own_index_goes_and_buckets_follow_rows(spark, docs, monkeypatch):
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    assert exact_dedup(docs).count() == len(texts()) and tables() == before
    assert exact_dedup_module.buckets_for(docs) == 8
    monkeypatch.setattr(exact_dedup_module, "BUCKET_ROWS", 3)
    assert exact_dedup_module.buckets_for(docs) == 16
