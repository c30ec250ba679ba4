"""Every query with an SQL twin gives the rows DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(contract.oracle_sql()[name])
    columns, types = [c[0] for c in cur.description], [str(c[1]) for c in cur.description]
    expected = cur.fetchall()
    assert {c: check.KINDS.get(t, t) for c, t in df.dtypes} == dict(zip(columns, types))
    assert check.fingerprint(df.columns, rows) == check.fingerprint(columns, expected)


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
