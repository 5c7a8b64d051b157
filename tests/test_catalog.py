"""Every catalog query against its SQL."""

import duckdb
import pytest

from weightloom.plans import catalog, figures, stores

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES | figures.QUERIES | stores.QUERIES, catalog.ORACLE_SQL | figures.ORACLE_SQL | stores.ORACLE_SQL
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings")


def rows(found, columns, names):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in columns)]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], columns, got.columns) == rows(want.fetchall(), columns, want.columns)
