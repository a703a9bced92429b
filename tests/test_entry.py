import duckdb
import pytest

import __spark_entry__ as entry
from quillbin.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    return x if isinstance(x, str) else repr(float(x))


def rows(df, columns):
    return sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))


def test_entry(spark):
    assert entry.entry(spark).columns == ["day", "total", "avg", "p95"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
