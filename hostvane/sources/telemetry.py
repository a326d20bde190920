"""Telemetry tables: reading, appending, and the projection of the driver's event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvane.schemas import telemetry_schema

PARTITIONS = ("run_id", "ingest_month")


def ingest_month(column: str = "ingestion_time") -> Column:
    return F.date_format(F.col(column), "yyyy-MM")


def read_telemetry(
    spark: SparkSession, path: str, run_id: str | None = None, ts_type: T.DataType | None = None
) -> DataFrame:
    """Stored telemetry; a run id prunes to that run's folders."""
    schema = telemetry_schema(ts_type).add("ingest_month", T.StringType())
    df = spark.read.schema(schema).parquet(path)
    return df.where(F.col("run_id") == F.lit(run_id)) if run_id else df


def write_telemetry(df: DataFrame, path: str, mode: str, file_rows: int = 5_000_000, lookups: bool = False) -> None:
    """Write rows under run and ingestion month. With ``lookups``, every row group has a Bloom filter over record_id, so a search
    for a record opens only the groups that may hold it.

    Rows are spread by ranges of (run, month, time, record), so a run or a month that holds most of the
    data is still written by many tasks, and each file covers a short span of time, which lets row-group
    statistics prune time filters.
    """
    rows = df if "ingest_month" in df.columns else df.withColumn("ingest_month", ingest_month())
    order = [*PARTITIONS, "metric_timestamp", "record_id"]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("maxRecordsPerFile", file_rows)
    if lookups:
        writer = writer.option("parquet.bloom.filter.enabled#record_id", "true")
    writer.partitionBy(*PARTITIONS).parquet(path)


def append_telemetry(df: DataFrame, path: str) -> None:
    """Append rows; nothing is written for an empty batch, and a failure is raised."""
    if not df.isEmpty():
        write_telemetry(df, path, "append")


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """The driver's ``events`` table seen as host telemetry (fixed projection, see FIXTURES.md)."""
    tier = "CAST(get_json_object(props, '$.k') AS DOUBLE)"
    rx = f"10.0D + {tier} / 10.0D"
    return events.selectExpr(
        "event_id AS record_id",
        "timestampadd(MILLISECOND, CAST(2000 + event_id % 501 AS INT), ts) AS ingestion_time",
        "ts AS metric_timestamp",
        "concat('host-', user_id) AS host_id",
        "concat('proj-', user_id % 7) AS project_id",
        "CASE user_id % 3 WHEN 0 THEN 'us-east1' WHEN 1 THEN 'us-west1' ELSE 'eu-west1' END AS region",
        "least(100.0D, value) AS cpu_usage",
        "least(100.0D, value * 0.7D + 20.0D + event_id % 5) AS memory_usage",
        "30.0D + event_id % 11 - 5 AS disk_utilization",
        f"{rx} AS network_rx_rate",
        f"({rx}) * 0.8D + event_id % 6 AS network_tx_rate",
        "props AS labels",
        "concat('run-', user_id % 2) AS run_id",
        "value > 150 AS is_anomaly",
        "CASE WHEN value > 150 THEN upper(event_type) END AS anomaly_type",
    )
