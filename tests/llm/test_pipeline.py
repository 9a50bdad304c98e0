"""The stages against plain Python, one after another on what the one before kept."""

import importlib
import os
import sys

import numpy as np
import pytest
from test_exact_dedup import bare
from test_near_dedup import components
from test_tokens import tiktoken_encoding
from test_toxicity import labelled

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = labelled(500, 8)
    docs += [(1000 + i, docs[i][1] + " ") for i in range(10)] + [(2000 + i, docs[i][1] + " more") for i in range(20, 25)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t)) for i, t in docs]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(labels)


def test_stages(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    path, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, path).cache()
        rows = out.collect()
        after = {r.doc_id for r in rows}
        assert after <= before.keys() and len(rows) == len(after)
        if name != "bpe":
            assert out.columns == columns
            docs = out
        kept[name] = after
        if name == "toxicity":
            wrong = [i for i in before if i in labels and (i in after) == bool(labels[i])]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "exact_dedup":
            assert {bare(before[i]) for i in after} == {bare(t) for t in before.values()} and len({bare(before[i]) for i in after}) == len(after)
        elif name == "near_dedup":
            assert after == set(components(list(before.items())).values())
        elif name == "mixing":
            assert 0.5 * len(before) < len(after) < len(before)
        else:
            encoding = tiktoken_encoding()
            for r in rows:
                assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(before[r.doc_id])
    assert {r.doc_id for r in pipeline.run(spark, path).collect()} == kept["bpe"]


def test_near_copies_from_eight_tenths_on(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = []
    for k, more in enumerate((14, 17, 19, 20, 21)):  # of 80 shingles: similarities 0.851, 0.825, 0.808, 0.8 and 0.792
        words = [f"w{k}x{i}" for i in range(84)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words + [f"more{k}x{i}" for i in range(more)]))]
    assert components(rows, 80) != components(rows)
    kept = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(components(rows, 80).values())) == [0, 10, 20, 30, 40, 41]


def test_contract():
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert pipeline.ORACLE_SQL is None and list(pipeline.queries()) == ["pipeline"]
