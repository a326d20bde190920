"""Every registered query against its check SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from check_oracles import TABLES, as_rows
from hostvane.plans import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert QUERIES.keys() == CHECKS.keys()


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(CHECKS[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert mine == as_rows(columns, found.fetchall())


@needs_tables
def test_entry(spark):
    assert entry(spark).count() > 0
