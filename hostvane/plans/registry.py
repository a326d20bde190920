"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DIGITS = 6
# Group sizes from which the _hot queries treat a group as too large for a task.
HOT_ROWS = 100
HOT_BUCKET_ROWS = 3


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of decimals: engines add up in different orders."""
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes]
    )


def with_ctes(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()
