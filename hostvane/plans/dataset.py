"""Queries over telemetry itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostvane.functions.features import preprocess, select_features
from hostvane.functions.filters import Filters, apply_filters
from hostvane.functions.timerules import bucket_seconds
from hostvane.operators import analytics, compare, paging
from hostvane.operators.ranks import Quantile, aggregate
from hostvane.operators.runs import latest_per
from hostvane.plans.registry import CHECKS, HOT_BUCKET_ROWS, HOT_ROWS, query, rounded, with_ctes
from hostvane.plans.tables import TELEMETRY_SQL, table, telemetry
from hostvane.schemas import FEATURES
from hostvane.session import scratch_path
from hostvane.sources.telemetry import append_telemetry, read_telemetry

T = TELEMETRY_SQL


def sql(select: str, *ctes: str) -> str:
    return with_ctes(T, *ctes, select=select)


def bucket(seconds: int) -> str:
    return f"make_timestamp(CAST(floor(epoch_us(metric_timestamp) / {seconds}e6) AS BIGINT) * {seconds} * 1000000)"


def agg_sql(metric: str, agg: str) -> str:
    inner = {
        "mean": f"avg({metric})",
        "min": f"min({metric})",
        "max": f"max({metric})",
        "p50": f"quantile_cont({metric}, 0.5)",
        "p95": f"quantile_cont({metric}, 0.95)",
    }[agg]
    return f"round({inner}, 6) AS {metric}_{agg}"


@query(
    "timeseries_hourly",
    sql(f"""
    SELECT run_id, {bucket(3600)} AS ts, count(*) AS count,
           {agg_sql('cpu_usage', 'mean')}, {agg_sql('cpu_usage', 'p95')}
    FROM telemetry GROUP BY 1, 2"""),
)
def timeseries_hourly(spark, sf_dir):
    return rounded(analytics.time_series(telemetry(spark, sf_dir), ["cpu_usage"], ["mean", "p95"], 3600))


SERIES_AGGS = ("mean", "min", "max", "p50", "p95")
MULTI = Filters(region="us-east1", start="2024-01-05T00:00:00", end="2024-01-25T12:00:00")


@query(
    "timeseries_multi",
    sql(f"""
    SELECT run_id, {bucket(21600)} AS ts, count(*) AS count,
           {', '.join(agg_sql(m, a) for m in FEATURES for a in SERIES_AGGS)}
    FROM telemetry
    WHERE region = 'us-east1' AND metric_timestamp >= TIMESTAMP '2024-01-05'
      AND metric_timestamp <= TIMESTAMP '2024-01-25 12:00:00'
    GROUP BY 1, 2"""),
)
def timeseries_multi(spark, sf_dir):
    width = bucket_seconds("auto", MULTI.start, MULTI.end)
    return rounded(analytics.time_series(telemetry(spark, sf_dir), FEATURES, SERIES_AGGS, width, MULTI))


@query(
    "timeseries_weekly_anomalies",
    sql(f"""
    SELECT run_id, {bucket(604800)} AS ts, count(*) AS count, {agg_sql('memory_usage', 'mean')}
    FROM telemetry WHERE is_anomaly GROUP BY 1, 2"""),
)
def timeseries_weekly_anomalies(spark, sf_dir):
    return rounded(
        analytics.time_series(
            telemetry(spark, sf_dir), ["memory_usage"], ["mean"], bucket_seconds("7d"), Filters(is_anomaly=True)
        )
    )


PERIOD = ("2024-01-15T00:00:00Z", "2024-01-21T00:00:00Z")
COMPARED = f"""
compared AS (
  SELECT run_id, {bucket(21600)} AS ts, count(*) AS n, avg(cpu_usage) AS mean, quantile_cont(cpu_usage, 0.95) AS p95
  FROM telemetry
  WHERE metric_timestamp >= TIMESTAMP '2024-01-15' AND metric_timestamp <= TIMESTAMP '2024-01-21' GROUP BY 1, 2),
earlier AS (
  SELECT run_id, {bucket(21600)} + INTERVAL 6 DAY AS ts, count(*) AS n, avg(cpu_usage) AS mean,
         quantile_cont(cpu_usage, 0.95) AS p95
  FROM telemetry
  WHERE metric_timestamp >= TIMESTAMP '2024-01-09' AND metric_timestamp <= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
"""


@query(
    "timeseries_compare",
    sql(
        """
    SELECT run_id, ts, c.n AS count, round(c.mean, 6) AS cpu_usage_mean, round(c.p95, 6) AS cpu_usage_p95,
           e.n AS baseline_count, round(e.mean, 6) AS baseline_cpu_usage_mean, round(e.p95, 6) AS baseline_cpu_usage_p95
    FROM compared c FULL JOIN earlier e USING (run_id, ts)""",
        COMPARED,
    ),
)
def timeseries_compare(spark, sf_dir):
    return rounded(compare.compare_series(telemetry(spark, sf_dir), ["cpu_usage"], ["mean", "p95"], 21600, *PERIOD))


@query(
    "period_delta",
    sql(
        """
    SELECT run_id, round(a, 6) AS current_mean, round(b, 6) AS baseline_mean, round(a - b, 6) AS delta,
           round((a - b) * 100 / b, 6) AS delta_percent
    FROM (SELECT run_id, avg(mean) AS a FROM compared GROUP BY 1)
    JOIN (SELECT run_id, avg(mean) AS b FROM earlier GROUP BY 1) USING (run_id)""",
        COMPARED,
    ),
)
def period_delta(spark, sf_dir):
    return rounded(compare.period_delta(telemetry(spark, sf_dir), "cpu_usage", "mean", 21600, *PERIOD))


LAG = "(epoch_us(ingestion_time) - epoch_us(metric_timestamp)) / 1e6"


@query(
    "dataset_summary",
    sql(f"""
    SELECT run_id, count(*) AS row_count, min(metric_timestamp) AS min_ts, max(metric_timestamp) AS max_ts,
           round(count_if(is_anomaly) / count(*), 6) AS anomaly_rate,
           count(DISTINCT host_id) AS distinct_host_id, count(DISTINCT project_id) AS distinct_project_id,
           count(DISTINCT region) AS distinct_region,
           round(quantile_cont({LAG}, 0.5), 6) AS lag_p50, round(quantile_cont({LAG}, 0.95), 6) AS lag_p95
    FROM telemetry GROUP BY 1"""),
)
def dataset_summary(spark, sf_dir):
    return rounded(analytics.dataset_summary(telemetry(spark, sf_dir)))


@query(
    "distinct_counts",
    sql("""
    SELECT run_id, count(DISTINCT host_id) AS distinct_host_id, count(DISTINCT project_id) AS distinct_project_id,
           count(DISTINCT region) AS distinct_region
    FROM telemetry GROUP BY 1"""),
)
def distinct_counts(spark, sf_dir):
    return analytics.distinct_counts(telemetry(spark, sf_dir))


@query(
    "ingest_lag_percentiles",
    sql(f"""
    SELECT run_id, round(quantile_cont({LAG}, 0.5), 6) AS lag_p50, round(quantile_cont({LAG}, 0.95), 6) AS lag_p95
    FROM telemetry GROUP BY 1"""),
)
def ingest_lag_percentiles(spark, sf_dir):
    return rounded(analytics.ingest_lag(telemetry(spark, sf_dir)))


@query(
    "anomaly_type_topk_other",
    sql(
        """
    SELECT run_id, CASE WHEN r <= 3 THEN anomaly_type ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS count
    FROM ranked_types GROUP BY 1, 2""",
        """
    ranked_types AS (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, anomaly_type) AS r
      FROM (SELECT run_id, anomaly_type, count(*) AS n FROM telemetry
            WHERE is_anomaly AND anomaly_type IS NOT NULL GROUP BY 1, 2))""",
    ),
)
def anomaly_type_topk_other(spark, sf_dir):
    return analytics.anomaly_types(telemetry(spark, sf_dir), 3)


@query(
    "anomaly_trend_24h",
    sql("""
    SELECT run_id, date_trunc('hour', metric_timestamp) AS ts, count(*) AS total,
           round(count_if(is_anomaly) / count(*), 6) AS anomaly_rate
    FROM telemetry JOIN (SELECT run_id, max(metric_timestamp) AS newest FROM telemetry GROUP BY 1) USING (run_id)
    WHERE metric_timestamp >= newest - INTERVAL 24 HOUR GROUP BY 1, 2"""),
)
def anomaly_trend_24h(spark, sf_dir):
    return rounded(analytics.anomaly_trend(telemetry(spark, sf_dir)))


@query(
    "anomaly_trend_one_run",
    sql("""
    SELECT run_id, date_trunc('hour', metric_timestamp) AS ts, count(*) AS total,
           round(count_if(is_anomaly) / count(*), 6) AS anomaly_rate
    FROM telemetry
    WHERE run_id = 'run-1' AND metric_timestamp >=
          (SELECT max(metric_timestamp) FROM telemetry WHERE run_id = 'run-1') - INTERVAL 24 HOUR
    GROUP BY 1, 2"""),
)
def anomaly_trend_one_run(spark, sf_dir):
    return rounded(analytics.anomaly_trend_of_run(telemetry(spark, sf_dir), "run-1"))


def top_sql(column: str, k: int, where: str = "") -> str:
    return f"""
    top_all AS (
      SELECT run_id, coalesce({column}, '') AS label, count(*) AS count,
             row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, coalesce({column}, '')) AS r,
             count(*) OVER (PARTITION BY run_id) > {k} AS truncated
      FROM telemetry {where} GROUP BY 1, 2)"""


@query(
    "topk_region",
    sql("SELECT run_id, label, count, truncated FROM top_all WHERE r <= 2", top_sql("region", 2)),
)
def topk_region(spark, sf_dir):
    return analytics.top_values(telemetry(spark, sf_dir), "region", 2)


@query(
    "topk_anomaly_type",
    sql("SELECT run_id, label, count, truncated FROM top_all WHERE r <= 10", top_sql("anomaly_type", 10)),
)
def topk_anomaly_type(spark, sf_dir):
    return analytics.top_values(telemetry(spark, sf_dir), "anomaly_type", 10)


@query(
    "topk_host_filtered",
    sql(
        """
    SELECT run_id, label, count, truncated, total_distinct FROM top_all
    JOIN (SELECT run_id, count(DISTINCT host_id) AS total_distinct FROM telemetry
          WHERE region = 'eu-west1' AND NOT is_anomaly GROUP BY 1) USING (run_id)
    WHERE r <= 10""",
        top_sql("host_id", 10, "WHERE region = 'eu-west1' AND NOT is_anomaly"),
    ),
)
def topk_host_filtered(spark, sf_dir):
    wanted = Filters(region="eu-west1", is_anomaly=False)
    return analytics.top_values(telemetry(spark, sf_dir), "host_id", 10, wanted, with_total=True)


def histogram_sql(metric: str, bins: int, bounds: str, where: str = "true") -> str:
    part = f"CAST(floor({bins} * ({metric} - lo) / (hi - lo)) AS INTEGER)"
    return sql(
        f"""
    SELECT run_id, bin, round(lo + (hi - lo) / {bins}e0 * bin, 6) AS edge_low,
           round(lo + (hi - lo) / {bins}e0 * (bin + 1), 6) AS edge_high, coalesce(n, 0) AS count
    FROM frame LEFT JOIN counts USING (run_id, bin)""",
        f"edges AS ({bounds})",
        f"frame AS (SELECT run_id, lo, hi, CAST(b AS INTEGER) AS bin FROM edges, range({bins}) AS x(b))",
        f"""counts AS (
      SELECT run_id, {part} AS bin, count(*) AS n
      FROM telemetry JOIN edges USING (run_id)
      WHERE {metric} >= lo AND {metric} < hi AND {where} GROUP BY 1, 2)""",
    )


@query(
    "histogram_cpu",
    histogram_sql("cpu_usage", 40, "SELECT run_id, min(cpu_usage) AS lo, max(cpu_usage) AS hi FROM telemetry GROUP BY 1"),
)
def histogram_cpu(spark, sf_dir):
    return rounded(analytics.histogram(telemetry(spark, sf_dir), "cpu_usage", 40))


@query(
    "histogram_cpu_fine",
    histogram_sql("cpu_usage", 800, "SELECT DISTINCT run_id, 0.0e0 AS lo, 100.0e0 AS hi FROM telemetry"),
)
def histogram_cpu_fine(spark, sf_dir):
    return rounded(analytics.histogram(telemetry(spark, sf_dir), "cpu_usage", 800, 0.0, 100.0))


@query(
    "histogram_filtered",
    histogram_sql(
        "memory_usage",
        25,
        "SELECT DISTINCT run_id, 30.0e0 AS lo, 90.0e0 AS hi FROM telemetry",
        "region = 'us-west1' AND metric_timestamp >= TIMESTAMP '2024-01-08'",
    ),
)
def histogram_filtered(spark, sf_dir):
    wanted = Filters(region="us-west1", start="2024-01-08T00:00:00")
    return rounded(analytics.histogram(telemetry(spark, sf_dir), "memory_usage", 25, 30.0, 90.0, wanted))


@query(
    "metric_stats",
    sql(
        " UNION ALL ".join(
            f"""SELECT run_id, count(*) AS count, '{m}' AS metric, round(min({m}), 6) AS min, round(max({m}), 6) AS max,
            round(avg({m}), 6) AS mean, round(quantile_cont({m}, 0.5), 6) AS p50, round(quantile_cont({m}, 0.95), 6) AS p95
            FROM telemetry GROUP BY 1"""
            for m in FEATURES
        )
    ),
)
def metric_stats(spark, sf_dir):
    return rounded(analytics.metric_stats(telemetry(spark, sf_dir)))


@query("metric_stats_hot", CHECKS["metric_stats"])
def metric_stats_hot(spark, sf_dir):
    """As if every run were too large for a task."""
    return rounded(analytics.metric_stats(telemetry(spark, sf_dir), group_rows=HOT_ROWS))


@query("timeseries_hot", CHECKS["timeseries_hourly"])
def timeseries_hot(spark, sf_dir):
    """Some buckets are above the limit, others are not."""
    hourly = analytics.time_series(telemetry(spark, sf_dir), ["cpu_usage"], ["mean", "p95"], 3600, group_rows=HOT_BUCKET_ROWS)
    return rounded(hourly)


BLANKED = "CASE WHEN user_id % 2 = 1 THEN NULL ELSE value END"


@query(
    "quantiles_of_blank_groups",
    f"""
    SELECT 'run-' || user_id % 2 AS run_id, count(*) AS count, count({BLANKED}) AS known,
           round(quantile_cont({BLANKED}, 0.95), 6) AS p95, round(quantile_cont(event_id, 0.5), 6) AS mid
    FROM events GROUP BY 1""",
)
def quantiles_of_blank_groups(spark, sf_dir):
    """A large group without any value stays, with NULL quantiles."""
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), (F.col("user_id") % 2).cast("string")).alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("v"),
        F.col("event_id").cast("double").alias("w"),
    )
    plain = [F.count(F.lit(1)).alias("count"), F.count("v").alias("known")]
    return rounded(aggregate(rows, ["run_id"], plain, {"p95": Quantile("v", 0.95), "mid": Quantile("w", 0.5)}, HOT_ROWS))


@query(
    "variance_rank",
    sql(
        """
    SELECT run_id, metric, round(s, 6) AS stddev,
           CAST(row_number() OVER (PARTITION BY run_id ORDER BY s DESC, metric) AS INTEGER) AS rank
    FROM spreads""",
        "spreads AS ("
        + " UNION ALL ".join(
            f"SELECT run_id, '{m}' AS metric, stddev_samp({m}) AS s FROM telemetry GROUP BY 1" for m in FEATURES
        )
        + ")",
    ),
)
def variance_rank(spark, sf_dir):
    return rounded(analytics.variance_rank(telemetry(spark, sf_dir)))


@query(
    "row_counts",
    sql("SELECT run_id, count(*) AS row_count, count_if(NOT is_anomaly) AS normal_count FROM telemetry GROUP BY 1"),
)
def row_counts(spark, sf_dir):
    return analytics.row_counts(telemetry(spark, sf_dir))


RECORD = """record_id, host_id, metric_timestamp, {metrics}, is_anomaly, coalesce(anomaly_type, '') AS anomaly_type,
  region, project_id, labels""".format(metrics=", ".join(f"round({m}, 6) AS {m}" for m in FEATURES))


@query(
    "record_search",
    sql(f"""
    SELECT {RECORD} FROM telemetry
    WHERE is_anomaly AND region = 'us-east1' AND metric_timestamp <= TIMESTAMP '2024-01-28'
    ORDER BY metric_timestamp DESC, record_id DESC LIMIT 50 OFFSET 20"""),
)
def record_search(spark, sf_dir):
    wanted = Filters(is_anomaly=True, region="us-east1", end="2024-01-28T00:00:00")
    return rounded(paging.search_records(telemetry(spark, sf_dir), wanted, 50, 20))


@query(
    "record_search_deep",
    sql(f"""
    SELECT {RECORD} FROM telemetry WHERE NOT is_anomaly
    ORDER BY metric_timestamp, record_id LIMIT 300 OFFSET 4000"""),
)
def record_search_deep(spark, sf_dir):
    """A page far into the order, picked by row number."""
    rows, order = paging.search_rows(telemetry(spark, sf_dir), Filters(is_anomaly=False), "asc")
    columns = [F.coalesce(c, F.lit("")).alias(c) if c == "anomaly_type" else F.col(c) for c in paging.RECORD_COLUMNS]
    return rounded(paging.page(rows.select(*columns), order, 300, 4000, shallow=1000))


@query(
    "page_summary",
    sql("""
    SELECT count(*) AS total, 50 AS limit, 400 AS offset, greatest(0, least(50, count(*) - 400)) AS returned,
           400 + greatest(0, least(50, count(*) - 400)) < count(*) AS has_more
    FROM telemetry WHERE is_anomaly"""),
)
def page_summary(spark, sf_dir):
    rows, _ = paging.search_rows(telemetry(spark, sf_dir), Filters(is_anomaly=True))
    return paging.page_summary(rows, 50, 400)


@query(
    "record_search_anchor",
    sql(f"""
    SELECT {RECORD} FROM telemetry WHERE metric_timestamp >= TIMESTAMP '2024-01-12 06:30:00'
    ORDER BY metric_timestamp, record_id LIMIT 40"""),
)
def record_search_anchor(spark, sf_dir):
    return rounded(
        paging.search_records(telemetry(spark, sf_dir), None, 40, sort_order="asc", anchor="2024-01-12T06:30:00Z")
    )


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in FEATURES)


@query(
    "newest_samples",
    sql(f"""
    SELECT {ROUNDED}, metric_timestamp, host_id, record_id FROM telemetry
    ORDER BY metric_timestamp DESC, record_id DESC LIMIT 100"""),
)
def newest_samples(spark, sf_dir):
    return rounded(paging.newest_samples(telemetry(spark, sf_dir), limit=100))


@query(
    "record_lookup",
    sql(
        f"""
    SELECT run_id, record_id, {ROUNDED}, metric_timestamp, host_id,
           CAST(json_extract_string(labels, '$.k') AS BIGINT) AS label_k
    FROM telemetry WHERE record_id IN (SELECT record_id FROM busiest WHERE r = 1)""",
        """busiest AS (
      SELECT record_id, row_number() OVER (PARTITION BY run_id, host_id ORDER BY cpu_usage DESC, record_id) AS r
      FROM telemetry)""",
    ),
)
def record_lookup(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    busiest = latest_per(rows, ["run_id", "host_id"], [F.desc("cpu_usage"), F.asc("record_id")])
    found = paging.lookup_records(rows, busiest)
    return rounded(found.withColumn("label_k", F.col("labels")["k"].cast("long")).drop("labels"))


@query(
    "labels_json",
    sql("""
    SELECT run_id, CAST(json_extract_string(labels, '$.k') AS BIGINT) AS label_k, count(*) AS count
    FROM telemetry GROUP BY 1, 2"""),
)
def labels_json(spark, sf_dir):
    rows = paging.parsed_labels(telemetry(spark, sf_dir))
    return rows.groupBy("run_id", F.col("labels")["k"].cast("long").alias("label_k")).agg(
        F.count(F.lit(1)).alias("count")
    )


@query(
    "incremental_scan",
    sql("""
    SELECT run_id, record_id, host_id, metric_timestamp FROM telemetry
    JOIN (SELECT run_id, max(record_id) AS last_record_id FROM telemetry
          WHERE ingestion_time < TIMESTAMP '2024-01-11' GROUP BY 1) USING (run_id)
    WHERE record_id > last_record_id"""),
)
def incremental_scan(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    scored = rows.where(F.col("ingestion_time") < F.lit("2024-01-11").cast("timestamp_ntz"))
    positions = scored.groupBy("run_id").agg(F.max("record_id").alias("last_record_id"))
    return paging.after_positions(rows, positions).select("run_id", "record_id", "host_id", "metric_timestamp")


@query(
    "normal_features",
    sql(f"SELECT record_id, {ROUNDED} FROM telemetry WHERE NOT is_anomaly"),
)
def normal_features(spark, sf_dir):
    return rounded(select_features(apply_filters(telemetry(spark, sf_dir), Filters(is_anomaly=False)), "record_id"))


@query(
    "preprocess_log1p",
    sql("""
    SELECT record_id, round(greatest(cpu_usage - 50, 0), 6) AS cpu_usage,
           round(greatest(memory_usage - 50, 0), 6) AS memory_usage,
           round(greatest(disk_utilization - 30, 0), 6) AS disk_utilization,
           round(ln(1 + greatest(network_rx_rate - 15, 0)), 6) AS network_rx_rate,
           round(ln(1 + greatest(network_tx_rate - 15, 0)), 6) AS network_tx_rate
    FROM telemetry"""),
)
def preprocess_log1p(spark, sf_dir):
    # Offsets that push some readings below zero, so the clamp has work to do.
    offsets = dict(zip(FEATURES, (50.0, 50.0, 30.0, 15.0, 15.0)))
    shifted = telemetry(spark, sf_dir).select("record_id", *[(F.col(f) - o).alias(f) for f, o in offsets.items()])
    return rounded(preprocess(shifted, log1p_network=True))


@query(
    "stored_by_month",
    sql("""
    SELECT run_id, strftime(ingestion_time, '%Y-%m') AS ingest_month, count(*) AS count,
           round(avg(cpu_usage), 6) AS cpu_usage_mean
    FROM telemetry GROUP BY 1, 2"""),
)
def stored_by_month(spark, sf_dir):
    """Written to a partitioned table and read back from it."""
    rows = telemetry(spark, sf_dir)
    path = scratch_path(spark, "telemetry")
    append_telemetry(rows, path)
    stored = read_telemetry(spark, path, ts_type=rows.schema["ingestion_time"].dataType)
    return rounded(
        stored.groupBy("run_id", "ingest_month").agg(
            F.count(F.lit(1)).alias("count"), F.avg("cpu_usage").alias("cpu_usage_mean")
        )
    )
