"""Queries over run, model, trial and inference metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostvane.operators import lifecycle, runs
from hostvane.operators.paging import page
from hostvane.plans.dataset import T
from hostvane.plans.models import scored, SCORED
from hostvane.plans.registry import query, rounded, with_ctes
from hostvane.plans.tables import (
    GENERATION_RUNS_SQL,
    INFERENCE_RUNS_SQL,
    MODEL_RUNS_SQL,
    generation_runs,
    inference_runs,
    model_runs,
    table,
    telemetry,
)

TRIALS = "trials AS (SELECT * FROM model_runs WHERE parent_run_id IS NOT NULL)"
ROLLUP = """
rollup_base AS (
  SELECT parent_run_id, count(*) AS trial_count, count_if(status = 'PENDING') AS pending_count,
         count_if(status = 'RUNNING') AS running_count, count_if(status = 'COMPLETED') AS completed_count,
         count_if(status = 'FAILED') AS failed_count
  FROM trials GROUP BY 1),
rolled AS (
  SELECT *, CASE WHEN running_count > 0 OR pending_count > 0 THEN 'RUNNING' WHEN completed_count > 0 THEN 'COMPLETED'
                 WHEN failed_count > 0 THEN 'FAILED' END AS rollup_status FROM rollup_base)
"""
BEST = """
best AS (
  SELECT parent_run_id, model_run_id AS best_trial_run_id, selection_metric_value AS best_metric_value,
         'reconstruction_error_threshold' AS best_metric_name
  FROM trials WHERE status = 'COMPLETED' AND is_eligible
  QUALIFY row_number() OVER (PARTITION BY parent_run_id
    ORDER BY selection_metric_value, completed_at, trial_index) = 1)
"""


def sql(select: str, *ctes: str) -> str:
    return with_ctes(MODEL_RUNS_SQL, TRIALS, *ctes, select=select)


@query("trial_rollup", sql("SELECT * FROM rolled", ROLLUP))
def trial_rollup(spark, sf_dir):
    return runs.trial_rollup(runs.trials_of(model_runs(spark, sf_dir)))


@query(
    "trial_rollup_of_parents",
    sql(
        """SELECT * FROM rolled WHERE parent_run_id IN (
        SELECT model_run_id FROM model_runs WHERE status = 'COMPLETED' AND parent_run_id IS NULL)""",
        ROLLUP,
    ),
)
def trial_rollup_of_parents(spark, sf_dir):
    models = model_runs(spark, sf_dir)
    parents = models.where(F.col("parent_run_id").isNull() & (F.col("status") == "COMPLETED"))
    return runs.trial_rollup(runs.trials_of(models, parents))


@query(
    "error_aggregates",
    sql("""
    SELECT parent_run_id, coalesce(json_extract_string(error_summary, '$.code'), 'UNKNOWN') AS code, count(*) AS count
    FROM trials WHERE status = 'FAILED' AND (error_summary IS NOT NULL OR error <> '') GROUP BY 1, 2"""),
)
def error_aggregates(spark, sf_dir):
    return runs.error_counts(runs.trials_of(model_runs(spark, sf_dir)))


@query("best_trial", sql("SELECT * FROM best", BEST))
def best_trial(spark, sf_dir):
    return runs.best_trials(runs.trials_of(model_runs(spark, sf_dir)))


@query(
    "trial_pages",
    sql("""
    SELECT parent_run_id, model_run_id, trial_index, status FROM trials
    QUALIFY row_number() OVER (PARTITION BY parent_run_id ORDER BY trial_index, model_run_id) BETWEEN 3 AND 5"""),
)
def trial_pages(spark, sf_dir):
    paged = runs.trial_pages(runs.trials_of(model_runs(spark, sf_dir)), 3, 2)
    return paged.select("parent_run_id", "model_run_id", "trial_index", "status")


@query(
    "run_list",
    with_ctes(
        GENERATION_RUNS_SQL,
        select="""
    SELECT * FROM generation_runs WHERE status = 'SUCCEEDED' AND created_at >= TIMESTAMP '2024-01-01 01:00:00'
    ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 10""",
    ),
)
def run_list(spark, sf_dir):
    return runs.list_runs(
        generation_runs(spark, sf_dir), "run_id", 50, 10, status="SUCCEEDED", created_from="2024-01-01T01:00:00"
    )


@query(
    "model_list",
    sql("""
    SELECT model_run_id, dataset_id, status, created_at FROM model_runs
    WHERE status = 'FAILED' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-12-31'
    ORDER BY created_at DESC, model_run_id LIMIT 200"""),
)
def model_list(spark, sf_dir):
    listed = runs.list_runs(
        model_runs(spark, sf_dir), "model_run_id", 200, status="FAILED", created_from="1996-01-01", created_to="1998-12-31"
    )
    return listed.select("model_run_id", "dataset_id", "status", "created_at")


@query(
    "models_of_datasets",
    sql("""
    SELECT dataset_id, model_run_id, name, status, created_at FROM model_runs
    ORDER BY dataset_id, created_at DESC, model_run_id"""),
)
def models_of_datasets(spark, sf_dir):
    return runs.models_by_dataset(model_runs(spark, sf_dir))


LISTING = """
listing AS (
  SELECT m.model_run_id, m.parent_run_id, m.created_at, m.selection_metric_value, r.trial_count, r.completed_count,
         b.best_metric_value, coalesce(r.rollup_status, m.status) AS status
  FROM model_runs m LEFT JOIN rolled r ON r.parent_run_id = m.model_run_id
  LEFT JOIN best b ON b.parent_run_id = m.model_run_id)
"""
LISTED = ["model_run_id", "parent_run_id", "created_at", "trial_count", "completed_count", "best_metric_value", "status"]
BY_BEST = "coalesce(best_metric_value, selection_metric_value, 99999.0), model_run_id"


def listing_sql(where: str, tail: str = "") -> str:
    return sql(f"SELECT {', '.join(LISTED)} FROM listing WHERE {where} {tail}", ROLLUP, BEST, LISTING)


@query(
    "model_listing_tuning",
    listing_sql("trial_count IS NOT NULL AND status IN ('COMPLETED', 'FAILED', 'CANCELLED')"),
)
def model_listing_tuning(spark, sf_dir):
    return rounded(runs.model_listing(model_runs(spark, sf_dir), "tuning", "terminal").select(*LISTED))


@query(
    "model_listing_single",
    listing_sql("trial_count IS NULL AND parent_run_id IS NULL AND status IN ('RUNNING', 'PENDING')"),
)
def model_listing_single(spark, sf_dir):
    return rounded(runs.model_listing(model_runs(spark, sf_dir), "single", "running").select(*LISTED))


@query("model_listing_best", listing_sql("true", f"ORDER BY {BY_BEST} LIMIT 100"))
def model_listing_best(spark, sf_dir):
    rows = runs.model_listing(model_runs(spark, sf_dir))
    return rounded(page(rows, runs.listing_order("best_metric"), 100).select(*LISTED))


@query(
    "inference_list",
    with_ctes(
        MODEL_RUNS_SQL,
        INFERENCE_RUNS_SQL,
        select="""
    SELECT inference_id, model_run_id, dataset_id, i.status, anomaly_count, round(coalesce(latency_ms, 0), 6) AS latency_ms,
           i.created_at
    FROM inference_runs i JOIN model_runs m USING (model_run_id)
    WHERE i.status = 'COMPLETED' AND i.created_at >= TIMESTAMP '2024-01-03'""",
    ),
)
def inference_list(spark, sf_dir):
    return rounded(
        runs.list_inference_runs(
            inference_runs(spark, sf_dir), model_runs(spark, sf_dir), status="COMPLETED", created_from="2024-01-03"
        )
    )


@query(
    "model_compare",
    sql(
        """
    SELECT best_trial_run_id AS left_id, t.model_run_id AS right_id,
           round(coalesce(t.threshold, 0) - coalesce(l.threshold, 0), 6) AS threshold_delta,
           coalesce(t.n_components, 0) - coalesce(l.n_components, 0) AS n_components_delta
    FROM best JOIN trials t USING (parent_run_id) JOIN model_runs l ON l.model_run_id = best_trial_run_id""",
        BEST,
    ),
)
def model_compare(spark, sf_dir):
    """Every trial against the best trial of its sweep."""
    models = model_runs(spark, sf_dir)
    trials = runs.trials_of(models)
    best = runs.best_trials(trials).select("parent_run_id", F.col("best_trial_run_id").alias("left_id"))
    pairs = trials.select("parent_run_id", F.col("model_run_id").alias("right_id")).join(best, "parent_run_id")
    return rounded(runs.compare_models(models, pairs.drop("parent_run_id")))




@query(
    "cascade_delete",
    with_ctes(
        T, SCORED, GENERATION_RUNS_SQL, MODEL_RUNS_SQL, INFERENCE_RUNS_SQL,
        "deleted AS (SELECT 'run-' || c_custkey AS dataset_id FROM customer WHERE c_mktsegment = 'MACHINERY')",
        select="""
    SELECT 'dataset_scores' AS table_name, count(*) AS rows FROM scored WHERE dataset_id NOT IN (FROM deleted)
    UNION ALL SELECT 'host_telemetry_archival', count(*) FROM telemetry WHERE run_id NOT IN (FROM deleted)
    UNION ALL SELECT 'model_runs', count(*) FROM model_runs WHERE dataset_id NOT IN (FROM deleted)
    UNION ALL SELECT 'generation_runs', count(*) FROM generation_runs WHERE run_id NOT IN (FROM deleted)
    UNION ALL SELECT 'inference_runs', count(*) FROM inference_runs WHERE model_run_id NOT IN (
      SELECT model_run_id FROM model_runs WHERE dataset_id IN (FROM deleted))""",
    ),
)
def cascade_delete(spark, sf_dir):
    """Rows left in each table after every dataset of one market segment is deleted."""
    tables = {
        "dataset_scores": scored(spark, sf_dir),
        "host_telemetry_archival": telemetry(spark, sf_dir),
        "model_runs": model_runs(spark, sf_dir),
        "generation_runs": generation_runs(spark, sf_dir),
        "inference_runs": inference_runs(spark, sf_dir),
    }
    segment = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    gone = segment.select(F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("dataset_id"))
    kept = lifecycle.without_datasets(tables, gone)
    counts = [
        df.groupBy().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in kept.items()
    ]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result
