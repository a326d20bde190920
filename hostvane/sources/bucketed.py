"""Tables dealt into the same buckets by record, so that joins on the record need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostvane.session import scratch_path

KEYS = ("run_id", "record_id")


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...] = KEYS, path: str | None = None) -> DataFrame:
    """Save ``df`` as ``table``, dealt into ``buckets`` by ``keys`` and sorted by them, and read it.

    Tables that are joined take the same ``buckets`` and keys of the same types in the same order. One task writes one bucket, so there is one file
    per bucket; choose ``buckets`` for a few hundred megabytes each.
    """
    path = path or scratch_path(df.sparkSession, "bucketed")
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forget the table; its files stay where they were written."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
