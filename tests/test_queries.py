"""Every registered query with SQL against DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, canonical
from workload.registry import ENTRIES

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert canonical(frame.columns, rows) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
