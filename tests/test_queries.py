"""Every tree query against its SQL, at the smallest size."""

import os

import pytest

import grove.queries as trees

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF}/{file}'")
    return db


def plain(rows, names):
    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return repr(round(float(v), 8) + 0.0)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(trees.oracle_sql()))
def test_query(spark, duck, name):
    df = trees.queries()[name](spark, SF)
    want = duck.execute(trees.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(trees.queries()) - set(trees.oracle_sql())))
def test_query_without_sql(spark, duck, name):
    assert trees.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
