"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registered
from check import TABLES, rows_of
from soundpairs.workload import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sum(got[1].values()) > 0
    if name in ORACLES:
        rel = db.execute(ORACLES[name])
        assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 1000


def test_only_the_approximate_search_goes_without_sql():
    assert set(QUERIES) - set(ORACLES) == {"n_nearest_approx"}
