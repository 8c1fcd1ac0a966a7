"""Every registered query of the retail engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from millrace.plans import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, connection, name):
    df = QUERIES[name](spark, SF)
    found = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = ordered(found.fetchall(), columns)
    assert ordered(df.collect(), df.columns) == want and want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
