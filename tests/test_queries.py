"""Every reference query against its SQL on DuckDB."""

import duckdb
import pytest

from segmentry.plans import dataprep, registry, retrieval, streaming, streams  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(rows):
    return sorted(repr(tuple(int(x) if isinstance(x, float) and x.is_integer() else x for x in r)) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    if name not in registry.SQL:
        assert got.count() > 0
        return
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert plain(got.select(names).collect()) == plain(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())
