"""The driver's tables, and the views the registered queries are written against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.sources.telemetry import telemetry_from_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(table(spark, sf_dir, "events"))


# The same projection for DuckDB; every check query starts with it.
TELEMETRY_SQL = """
telemetry AS (
  SELECT event_id AS record_id,
         ts + to_milliseconds(2000 + event_id % 501) AS ingestion_time,
         ts AS metric_timestamp,
         'host-' || user_id AS host_id,
         'proj-' || user_id % 7 AS project_id,
         CASE user_id % 3 WHEN 0 THEN 'us-east1' WHEN 1 THEN 'us-west1' ELSE 'eu-west1' END AS region,
         least(100.0e0, value) AS cpu_usage,
         least(100.0e0, value * 0.7e0 + 20.0e0 + event_id % 5) AS memory_usage,
         30.0e0 + event_id % 11 - 5 AS disk_utilization,
         10.0e0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0e0 AS network_rx_rate,
         (10.0e0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0e0) * 0.8e0 + event_id % 6
           AS network_tx_rate,
         props AS labels,
         'run-' || user_id % 2 AS run_id,
         value > 150 AS is_anomaly,
         CASE WHEN value > 150 THEN upper(event_type) END AS anomaly_type
  FROM events
)
"""


def generation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation run per customer."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        F.when(balance < 0, "FAILED").when(balance < 1000, "RUNNING").otherwise("SUCCEEDED").alias("status"),
        F.timestamp_add("MINUTE", key.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
        (key * 10).alias("inserted_rows"),
        F.col("c_mktsegment").alias("tier"),
    )


GENERATION_RUNS_SQL = """
generation_runs AS (
  SELECT 'run-' || c_custkey AS run_id,
         CASE WHEN c_acctbal < 0 THEN 'FAILED' WHEN c_acctbal < 1000 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status,
         TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at,
         c_custkey * 10 AS inserted_rows,
         c_mktsegment AS tier
  FROM customer
)
"""


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model run per order: of every ten keys one tuning parent, eight trials and one single run."""
    key, place = F.col("o_orderkey"), F.col("o_orderkey") % 10
    is_trial = place.between(1, 8)
    state, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = (
        F.when(state == "O", "COMPLETED")
        .when(state == "F", "FAILED")
        .when(priority == "1-URGENT", "RUNNING")
        .when(priority == "2-HIGH", "PENDING")
        .otherwise("COMPLETED")
    )
    done, failed = F.col("status") == "COMPLETED", F.col("status") == "FAILED"
    named = priority.isin("2-HIGH", "3-MEDIUM", "5-LOW")
    model_id = lambda k: F.concat(F.lit("model-"), k.cast("string"))
    ended = F.timestamp_add("HOUR", (key % 3).cast("int"), F.col("o_orderdate"))
    return (
        table(spark, sf_dir, "orders")
        .withColumn("status", status)
        .select(
            model_id(key).alias("model_run_id"),
            F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("dataset_id"),
            F.concat(F.lit("pca-"), F.lower(state)).alias("name"),
            "status",
            F.when(is_trial, model_id(key - place)).alias("parent_run_id"),
            F.when(is_trial, (place - 1).cast("int")).alias("trial_index"),
            (priority != "5-LOW").alias("is_eligible"),
            F.when(done, F.floor(F.col("o_totalprice") / 100000).cast("double")).alias("selection_metric_value"),
            F.col("o_orderdate").alias("created_at"),
            F.when(done | failed, ended).alias("completed_at"),
            F.when(failed, F.when(priority == "4-NOT SPECIFIED", "").otherwise("trial failed")).alias("error"),
            F.when(
                failed & named, F.concat(F.lit('{"code":"E_'), F.substring(priority, 3, 20), F.lit('","stage":"train"}'))
            ).alias("error_summary"),
            F.when(done, F.col("o_totalprice") / 1000).alias("threshold"),
            F.when(done, (key % 5 + 1).cast("int")).alias("n_components"),
        )
    )


MODEL_RUNS_SQL = """
model_base AS (
  SELECT *, o_orderkey % 10 AS place,
         CASE WHEN o_orderstatus = 'O' THEN 'COMPLETED' WHEN o_orderstatus = 'F' THEN 'FAILED'
              WHEN o_orderpriority = '1-URGENT' THEN 'RUNNING' WHEN o_orderpriority = '2-HIGH' THEN 'PENDING'
              ELSE 'COMPLETED' END AS status
  FROM orders
),
model_runs AS (
  SELECT 'model-' || o_orderkey AS model_run_id,
         'run-' || o_custkey AS dataset_id,
         'pca-' || lower(o_orderstatus) AS name,
         status,
         CASE WHEN place BETWEEN 1 AND 8 THEN 'model-' || (o_orderkey - place) END AS parent_run_id,
         CASE WHEN place BETWEEN 1 AND 8 THEN CAST(place - 1 AS INTEGER) END AS trial_index,
         o_orderpriority <> '5-LOW' AS is_eligible,
         CASE WHEN status = 'COMPLETED' THEN floor(o_totalprice / 100000) END AS selection_metric_value,
         o_orderdate AS created_at,
         CASE WHEN status IN ('COMPLETED', 'FAILED') THEN o_orderdate + to_hours(o_orderkey % 3) END AS completed_at,
         CASE WHEN status = 'FAILED'
              THEN CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'trial failed' END END AS error,
         CASE WHEN status = 'FAILED' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW')
              THEN '{"code":"E_' || substr(o_orderpriority, 3) || '","stage":"train"}' END AS error_summary,
         CASE WHEN status = 'COMPLETED' THEN o_totalprice / 1000 END AS threshold,
         CASE WHEN status = 'COMPLETED' THEN CAST(o_orderkey % 5 + 1 AS INTEGER) END AS n_components
  FROM model_base
)
"""


def inference_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inference run per event, against the tuning parent numbered after the user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("inf-"), F.col("event_id").cast("string")).alias("inference_id"),
        F.concat(F.lit("model-"), (F.col("user_id") * 10).cast("string")).alias("model_run_id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
        F.floor("value").alias("anomaly_count"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("latency_ms"),
        F.col("ts").alias("created_at"),
    )


INFERENCE_RUNS_SQL = """
inference_runs AS (
  SELECT 'inf-' || event_id AS inference_id,
         'model-' || (user_id * 10) AS model_run_id,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
         CAST(floor(value) AS BIGINT) AS anomaly_count,
         CASE WHEN event_type <> 'view' THEN value END AS latency_ms,
         ts AS created_at
  FROM events
)
"""


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model scored which dataset when: one row per line item, many per pair."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("model-"), F.col("l_partkey").cast("string")).alias("model_run_id"),
        F.col("l_shipdate").alias("scored_at"),
    )


SCORE_HISTORY_SQL = """
score_history AS (
  SELECT 'run-' || l_suppkey AS dataset_id, 'model-' || l_partkey AS model_run_id, l_shipdate AS scored_at
  FROM lineitem
)
"""


def score_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score job per order: which model scores which dataset, and how far it is."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(state == "O", "COMPLETED").when(state == "F", F.when(key % 5 == 0, "FAILED").otherwise("RUNNING")).otherwise("PENDING")
    total = (key % 1000 + 1).cast("long")
    named = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    rows = table(spark, sf_dir, "orders").withColumn("status", status).withColumn("total_rows", total)
    done = F.when(F.col("status") == "COMPLETED", F.col("total_rows")).when(F.col("status") == "PENDING", F.lit(0))
    return rows.select(
        named("job-", key).alias("job_id"),
        named("run-", F.col("o_custkey") % 50).alias("dataset_id"),
        named("model-", key % 7).alias("model_run_id"),
        "status",
        "total_rows",
        F.coalesce(done, F.floor(F.col("total_rows") / 3)).cast("long").alias("processed_rows"),
        F.timestamp_add("SECOND", (key % 60).cast("int"), F.col("o_orderdate")).alias("created_at"),
    )


SCORE_JOBS_SQL = """
score_jobs_base AS (
  SELECT *, o_orderkey % 1000 + 1 AS total_rows,
         CASE WHEN o_orderstatus = 'O' THEN 'COMPLETED' WHEN o_orderstatus <> 'F' THEN 'PENDING'
              WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS status
  FROM orders
),
score_jobs AS (
  SELECT 'job-' || o_orderkey AS job_id, 'run-' || (o_custkey % 50) AS dataset_id, 'model-' || (o_orderkey % 7) AS model_run_id,
         status, total_rows,
         CASE status WHEN 'COMPLETED' THEN total_rows WHEN 'PENDING' THEN 0 ELSE total_rows // 3 END AS processed_rows,
         o_orderdate + to_seconds(o_orderkey % 60) AS created_at
  FROM score_jobs_base
)
"""
