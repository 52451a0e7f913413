"""Every registered query with SQL, over the whole tables of a small scale, against DuckDB."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cairn.plans import archive_queries, problems, relational_queries, source_queries  # noqa: E402, F401

QUERIES, SQL = archive_queries.QUERIES | problems.queries(), archive_queries.SQL | problems.oracle_sql()


@pytest.fixture(scope="module")
def database(folder):
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return db


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, folder, database, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    result = database.execute(f"select {', '.join(columns)} from ({SQL[name]})")
    assert got == ordered(result.fetchall()) and got


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"p1_found", "p2_found", "p4_found", "p5_found"} <= names
    assert entry.entry(spark).count() > 0
