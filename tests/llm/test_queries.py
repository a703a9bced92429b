import duckdb
import pytest

import __spark_entry__ as entry
from quillbin.llm import registry

TABLES = ("documents", "benchmark", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()
