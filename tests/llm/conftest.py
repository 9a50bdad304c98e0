import pytest
from samples import texts

#: Names that operators use inside, and of the pipeline's columns.
EXTRA = ["lang", "source", "n_chars", "digest", "keep_id", "kept", "key", "id", "row", "word", "n", "component_id", "set_key", "part", "score", "tokens", "text_sha256", "_sha256"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "de", None][(i or 0) % 3], f"s{(i or 0) % 4}" if (i or 0) % 7 else None, len(t or ""), *["clash"] * (len(EXTRA) - 3)) for i, t in texts()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA[3:])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
