"""Every registered query of the reference's operators against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from gridloom.plans import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else x + 0.0 if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["i", "v"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
