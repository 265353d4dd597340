"""Every registered query against its SQL statement in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, db, small, name):
    df = entry.queries()[name](spark, small)
    mine = (df.columns, [tuple(r) for r in df.collect()])
    assert mine[1]
    if name in SQL:
        cursor = db.execute(SQL[name])
        assert check.compare(mine, ([d[0] for d in cursor.description], cursor.fetchall())) == ""


def test_every_statement_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["gameid", "playid", "nflid", "jerseynumber"]
    assert df.count() > 0
