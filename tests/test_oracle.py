"""Every registered linkage query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from kinweave.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sql.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert sorted(str(list(r)) for r in df.select(*columns).collect()) == want


def test_all_have_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
