"""Queries over stored tables: retention and deletes in place, roll-ups, lookups and co-located joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostvane.functions.filters import Filters
from hostvane.operators import expiry, paging, rollups, runs, training
from hostvane.plans.dataset import T, bucket
from hostvane.plans.metadata import GENERATION_RUNS_SQL, INFERENCE_RUNS_SQL, MODEL_RUNS_SQL
from hostvane.plans.models import KEPT, NOW, SCORED, scored
from hostvane.plans.registry import query, rounded, with_ctes
from hostvane.plans.tables import (
    SCORE_JOBS_SQL,
    generation_runs,
    inference_runs,
    model_runs,
    score_jobs,
    table,
    telemetry,
)
from hostvane.schemas import FEATURES
from hostvane.session import scratch_path
from hostvane.sources.bucketed import write_bucketed
from hostvane.sources.results import read_scores, write_scores
from hostvane.sources.telemetry import append_telemetry, read_telemetry, write_telemetry

DAYS = 21
NUDGE = 1e-9  # means that end in a half at the last decimal shown are rounded one way, however they were added up


def stored_telemetry(spark, sf_dir, **options):
    """(path, type of times) of the telemetry view as a stored table."""
    rows = telemetry(spark, sf_dir)
    path = scratch_path(spark, "telemetry")
    write_telemetry(rows, path, "append", **options)
    return path, rows.schema["ingestion_time"].dataType


def expired_tables(spark, sf_dir):
    path, kind = stored_telemetry(spark, sf_dir)
    scores_path = scratch_path(spark, "scores")
    write_scores(scored(spark, sf_dir).select("dataset_id", "model_run_id", "record_id", "reconstruction_error", "predicted_is_anomaly"), scores_path)
    expiry.expire(spark, path, scores_path, NOW, DAYS, scratch_path(spark, "retention-plan"), ts_type=kind)
    return read_telemetry(spark, path, ts_type=kind), read_scores(spark, scores_path)


@query("retention_stored", with_ctes(T, KEPT, select="SELECT run_id, record_id, ingestion_time, host_id FROM kept"))
def retention_stored(spark, sf_dir):
    """Old telemetry dropped from a stored table in place."""
    return expired_tables(spark, sf_dir)[0].select("run_id", "record_id", "ingestion_time", "host_id")


@query(
    "retention_stored_scores",
    with_ctes(
        T,
        SCORED,
        KEPT,
        select="""SELECT dataset_id, model_run_id, record_id, predicted_is_anomaly FROM scored
        WHERE record_id IN (SELECT record_id FROM kept)""",
    ),
)
def retention_stored_scores(spark, sf_dir):
    """The scores of dropped telemetry, dropped in place as well."""
    return expired_tables(spark, sf_dir)[1].select("dataset_id", "model_run_id", "record_id", "predicted_is_anomaly")


@query(
    "cascade_delete_stored",
    with_ctes(
        T, SCORED, GENERATION_RUNS_SQL, MODEL_RUNS_SQL, INFERENCE_RUNS_SQL,
        "deleted AS (SELECT 'run-1' AS dataset_id UNION ALL SELECT 'run-' || c_custkey FROM customer WHERE c_custkey % 3 = 2)",
        select="""
    SELECT 'dataset_scores' AS table_name, count(*) AS rows FROM scored WHERE dataset_id NOT IN (FROM deleted)
    UNION ALL SELECT 'host_telemetry_archival', count(*) FROM telemetry WHERE run_id NOT IN (FROM deleted)
    UNION ALL SELECT 'model_runs', count(*) FROM model_runs WHERE dataset_id NOT IN (FROM deleted)
    UNION ALL SELECT 'generation_runs', count(*) FROM generation_runs WHERE run_id NOT IN (FROM deleted)
    UNION ALL SELECT 'inference_runs', count(*) FROM inference_runs WHERE model_run_id NOT IN (
      SELECT model_run_id FROM model_runs WHERE dataset_id IN (FROM deleted))""",
    ),
)
def cascade_delete_stored(spark, sf_dir):
    """Rows left in each stored table after some datasets were deleted from all of them."""
    paths = {"host_telemetry_archival": stored_telemetry(spark, sf_dir)[0], "dataset_scores": scratch_path(spark, "scores")}
    write_scores(scored(spark, sf_dir).select("dataset_id", "model_run_id", "record_id", "reconstruction_error", "predicted_is_anomaly"), paths["dataset_scores"])
    for name, build in (("model_runs", model_runs), ("generation_runs", generation_runs), ("inference_runs", inference_runs)):
        paths[name] = scratch_path(spark, name)
        build(spark, sf_dir).write.parquet(paths[name])
    numbers = table(spark, sf_dir, "customer").where("c_custkey % 3 = 2").select("c_custkey")
    gone = numbers.unionByName(spark.range(1, 2).select(F.col("id").alias("c_custkey"))).select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("dataset_id")
    )
    expiry.delete_datasets(spark, paths, gone, scratch_path(spark, "delete-plan"))
    counts = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def two_loads(spark, sf_dir, build):
    """Parts of a stored table refreshed after each of two loads."""
    rows = telemetry(spark, sf_dir)
    kind = rows.schema["ingestion_time"].dataType
    path, parts = scratch_path(spark, "telemetry"), scratch_path(spark, "parts")
    for load in ("ingestion_time < TIMESTAMP_NTZ '2024-01-20'", "NOT ingestion_time < TIMESTAMP_NTZ '2024-01-20'"):
        append_telemetry(rows.where(load), path)
        rollups.refresh(spark, path, parts, build, kind)
    return rollups.read_parts(spark, parts)


ROLLED = Filters(region="us-east1", start="2024-01-03T06:00:00", end="2024-01-28T00:00:00")


@query(
    "rollup_series",
    with_ctes(
        T,
        select=f"""
    SELECT run_id, {bucket(21600)} AS ts, count(*) AS count,
           {', '.join(f'round(avg({m}) + {NUDGE}, 6) AS {m}_mean, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max' for m in FEATURES)}
    FROM telemetry WHERE region = 'us-east1' AND metric_timestamp >= TIMESTAMP '2024-01-03 06:00:00'
      AND metric_timestamp < TIMESTAMP '2024-01-28' GROUP BY 1, 2""",
    ),
)
def rollup_series(spark, sf_dir):
    """Six-hour buckets of one region from stored 300-second parts."""
    parts = two_loads(spark, sf_dir, rollups.series_parts())
    series = rollups.rolled_series(parts, FEATURES, ["mean", "min", "max"], 21600, ROLLED)
    return rounded(series.withColumns({f"{m}_mean": F.col(f"{m}_mean") + F.lit(NUDGE) for m in FEATURES}))


@query(
    "rollup_quantiles",
    with_ctes(
        T,
        select=f"""
    SELECT run_id, {bucket(3600)} AS ts, count(*) AS count, round(quantile_disc(cpu_usage, 0.5), 6) AS cpu_usage_p50,
           round(quantile_disc(cpu_usage, 0.95), 6) AS cpu_usage_p95 FROM telemetry GROUP BY 1, 2""",
    ),
)
def rollup_quantiles(spark, sf_dir):
    """Quantiles merged from sketches, which hold every value of buckets as small as these."""
    parts = two_loads(spark, sf_dir, rollups.series_parts(sketches=True))
    return rounded(rollups.rolled_series(parts, ["cpu_usage"], ["p50", "p95"], 3600))


@query(
    "rollup_anomaly_rate",
    with_ctes(
        T,
        select=f"""SELECT run_id, {bucket(3600)} AS ts, count(*) AS total,
        round(count_if(is_anomaly) / count(*), 6) AS anomaly_rate FROM telemetry GROUP BY 1, 2""",
    ),
)
def rollup_anomaly_rate(spark, sf_dir):
    return rounded(rollups.rolled_anomaly_rate(two_loads(spark, sf_dir, rollups.series_parts())))


@query(
    "pca_stats_incremental",
    with_ctes(
        T,
        select=f"""
    SELECT run_id, count(*) AS n, {', '.join(f'round(avg({f}), 6) AS mean_{f}' for f in FEATURES)},
           {', '.join(f'round(covar_samp({FEATURES[i]}, {FEATURES[j]}), 6) AS cov_{i}_{j}' for i, j in training.PAIRS)}
    FROM telemetry GROUP BY 1""",
    ),
)
def pca_stats_incremental(spark, sf_dir):
    """Training moments merged from stored parts of two loads."""
    return rounded(rollups.merged_moments(two_loads(spark, sf_dir, rollups.moment_parts)))


@query(
    "distinct_by_range",
    with_ctes(
        T,
        select="""
    SELECT run_id, count(DISTINCT host_id) AS hosts, count(DISTINCT project_id) AS projects, count(DISTINCT region) AS regions
    FROM telemetry WHERE metric_timestamp >= TIMESTAMP '2024-01-04' AND metric_timestamp < TIMESTAMP '2024-01-06 12:00:00'
    GROUP BY 1""",
    ),
)
def distinct_by_range(spark, sf_dir):
    """Distinct hosts of a time range from stored sketches, which count as few hosts as these exactly."""
    parts = two_loads(spark, sf_dir, rollups.distinct_parts)
    return rollups.distinct_over(parts, "2024-01-04T00:00:00", "2024-01-06T12:00:00")


@query(
    "confusion_colocated",
    with_ctes(
        T,
        SCORED,
        select="""
    SELECT dataset_id, count_if(predicted_is_anomaly AND is_anomaly) AS tp, count_if(predicted_is_anomaly AND NOT is_anomaly) AS fp,
           count_if(NOT predicted_is_anomaly AND NOT is_anomaly) AS tn, count_if(NOT predicted_is_anomaly AND is_anomaly) AS fn
    FROM scored GROUP BY 1""",
    ),
)
def confusion_colocated(spark, sf_dir):
    """Scores and labels in tables dealt alike by record, joined without a shuffle."""
    return rounded(confusion_of(*colocated(spark, sf_dir)))


def colocated(spark, sf_dir, buckets: int = 8):
    """(scores, telemetry) as bucketed tables."""
    tag = uuid.uuid4().hex
    scores = scored(spark, sf_dir).withColumnRenamed("dataset_id", "run_id")
    return (
        write_bucketed(scores.select("run_id", "record_id", "predicted_is_anomaly"), f"scores_{tag}", buckets),
        write_bucketed(telemetry(spark, sf_dir).select("run_id", "record_id", "is_anomaly"), f"telemetry_{tag}", buckets),
    )


def confusion_of(scores, rows):
    joined = scores.join(rows, ["run_id", "record_id"])
    flag, truth = F.col("predicted_is_anomaly"), F.col("is_anomaly")
    cells = {"tp": flag & truth, "fp": flag & ~truth, "tn": ~flag & ~truth, "fn": ~flag & truth}
    return joined.groupBy(F.col("run_id").alias("dataset_id")).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


LOOKED_UP = (3, 77, 4242, 99_999_999)


@query(
    "record_lookup_filtered",
    with_ctes(
        T,
        select=f"""SELECT run_id, record_id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)}, host_id FROM telemetry
        WHERE run_id = 'run-1' AND record_id IN {LOOKED_UP}""",
    ),
)
def record_lookup_filtered(spark, sf_dir):
    """Records of one run looked up in row groups with Bloom filters."""
    path, kind = stored_telemetry(spark, sf_dir, lookups=True)
    rows = read_telemetry(spark, path, "run-1", kind).where(F.col("record_id").isin(*LOOKED_UP))
    return rounded(rows.select("run_id", "record_id", *FEATURES, "host_id"))


@query(
    "incremental_scan_pruned",
    with_ctes(
        T,
        select="""SELECT run_id, record_id FROM telemetry
        WHERE record_id > CASE run_id WHEN 'run-0' THEN 4000 ELSE -1 END""",
    ),
)
def incremental_scan_pruned(spark, sf_dir):
    """Saved positions as bounds of the scan; a run without one is read from the start."""
    positions = spark.range(1).select(F.lit("run-0").alias("run_id"), F.lit(4000).cast("long").alias("last_record_id"))
    path, kind = stored_telemetry(spark, sf_dir)
    return paging.after_positions(read_telemetry(spark, path, ts_type=kind), positions).select("run_id", "record_id")


@query(
    "score_job_list",
    with_ctes(
        SCORE_JOBS_SQL,
        select="""
    SELECT job_id, dataset_id, model_run_id, status, total_rows, processed_rows, created_at FROM score_jobs
    WHERE status = 'RUNNING' ORDER BY created_at DESC, job_id LIMIT 100""",
    ),
)
def score_job_list(spark, sf_dir):
    """Score jobs that run now, newest first."""
    return runs.list_score_jobs(score_jobs(spark, sf_dir), 100, status="RUNNING")


@query(
    "score_job_progress",
    with_ctes(
        SCORE_JOBS_SQL,
        select="""
    SELECT dataset_id, model_run_id, count(*) AS jobs, count_if(status IN ('PENDING', 'RUNNING')) AS unfinished,
           CAST(sum(processed_rows) AS BIGINT) AS processed_rows, CAST(sum(total_rows) AS BIGINT) AS total_rows,
           round(CAST(sum(processed_rows) AS DOUBLE) / sum(total_rows), 6) AS progress
    FROM score_jobs GROUP BY ALL""",
    ),
)
def score_job_progress(spark, sf_dir):
    """How far the jobs of each dataset and model are."""
    return rounded(runs.score_job_progress(score_jobs(spark, sf_dir)))
