"""Registered corpus queries against their check SQL on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from corpus_fixtures import tables  # noqa: F401
from check_oracles import TABLES, as_rows
from hostvane.llm.queries import CHECKS, QUERIES


@pytest.fixture(scope="module")
def db(tables):  # noqa: F811
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, db, tables, name):  # noqa: F811
    df = QUERIES[name](spark, tables)
    mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(CHECKS[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert mine == as_rows(columns, found.fetchall())


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
