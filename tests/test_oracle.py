"""Every registered query that has SQL must give the same rows in DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tools.check import NAMES, rows_of

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def compare(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, name)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
