"""Listings and roll-ups over run, model, trial and job metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.functions import checks
from hostvane.functions.filters import between_times
from hostvane.operators.joins import join_checked
from hostvane.operators.paging import page
from hostvane.operators.toprows import RANK, top_rows

# Trial states, and what counts as unfinished or finished in a listing.
STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED")
UNFINISHED = ("RUNNING", "PENDING")
FINISHED = ("COMPLETED", "FAILED", "CANCELLED")
NO_METRIC = 99999.0
METRIC_NAME = "reconstruction_error_threshold"


def matching_runs(
    runs: DataFrame,
    status: str | None = None,
    dataset_id: str | None = None,
    model_run_id: str | None = None,
    created_from=None,
    created_to=None,
) -> DataFrame:
    for column, wanted in (("status", status), ("dataset_id", dataset_id), ("model_run_id", model_run_id)):
        if wanted:
            runs = runs.where(F.col(column) == F.lit(wanted))
    return between_times(runs, "created_at", created_from, created_to)


def list_runs(runs: DataFrame, id_column: str, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Newest first. ``filters`` as in ``matching_runs``."""
    return page(matching_runs(runs, **filters), [F.desc("created_at"), F.asc(id_column)], limit, offset)


JOB_COLUMNS = ("job_id", "dataset_id", "model_run_id", "status", "total_rows", "processed_rows", "created_at")


def list_score_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Score jobs newest first, with their progress counts. ``filters`` as in ``matching_runs``."""
    return list_runs(jobs, "job_id", limit, offset, **filters).select(*JOB_COLUMNS)


def score_job_progress(jobs: DataFrame, **filters) -> DataFrame:
    """Per dataset and model: jobs, unfinished ones, rows scored of all, and their share (NULL without rows)."""
    return matching_runs(jobs, **filters).groupBy("dataset_id", "model_run_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status").isin(*UNFINISHED)).alias("unfinished"),
        F.sum("processed_rows").alias("processed_rows"),
        F.sum("total_rows").alias("total_rows"),
        F.try_divide(F.sum("processed_rows"), F.sum("total_rows")).alias("progress"),
    )


def list_inference_runs(
    inferences: DataFrame,
    models: DataFrame,
    dataset_id: str | None = None,
    model_run_id: str | None = None,
    status: str | None = None,
    created_from=None,
    created_to=None,
) -> DataFrame:
    """Inference runs with the dataset of their model; a missing latency reads as 0."""
    mine = matching_runs(inferences, status, None, model_run_id, created_from, created_to)
    owners = models.select("model_run_id", "dataset_id")
    if dataset_id:
        owners = owners.where(F.col("dataset_id") == F.lit(dataset_id))
    return mine.join(owners, "model_run_id").select(
        "inference_id", "model_run_id", "dataset_id", "status", "anomaly_count",
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), "created_at",
    )


def models_of_dataset(models: DataFrame, dataset_id: str) -> DataFrame:
    rows = matching_runs(models, dataset_id=dataset_id)
    return rows.select("model_run_id", "name", "status", "created_at").orderBy(F.desc("created_at"), "model_run_id")


def models_by_dataset(models: DataFrame) -> DataFrame:
    """Every dataset's models, newest first within the dataset; sorted in ranges, so a large dataset is split."""
    rows = models.select("dataset_id", "model_run_id", "name", "status", "created_at")
    return rows.orderBy("dataset_id", F.desc("created_at"), "model_run_id")


def trials_of(models: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Trial rows, restricted to the ``model_run_id`` values of ``parents`` when given."""
    trials = models.where(F.col("parent_run_id").isNotNull())
    if parents is None:
        return trials
    wanted = parents.select(F.col("model_run_id").alias("parent_run_id"))
    return join_checked(trials, wanted.distinct(), ["parent_run_id"], "left_semi")


def list_trials(models: DataFrame, parent_run_id: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    mine = models.where(F.col("parent_run_id") == F.lit(parent_run_id))
    return page(mine, [F.asc("trial_index"), F.asc("model_run_id")], limit, offset)


def trial_pages(trials: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    """The same page of every parent's trials."""
    head = top_rows(trials, ["parent_run_id"], [F.asc("trial_index"), F.asc("model_run_id")], offset + limit)
    return head.where(F.col(RANK) > offset).drop(RANK)


def trial_rollup(trials: DataFrame) -> DataFrame:
    """Trial counts per state for each parent, and the state the parent shows."""
    counts = trials.groupBy("parent_run_id").agg(
        F.count(F.lit(1)).alias("trial_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in STATES],
    )
    return counts.withColumn("rollup_status", rollup_status())


def rollup_status():
    """Running while any trial is open, then completed if any succeeded, then failed; NULL to keep the parent's own."""
    return (
        F.when((F.col("running_count") > 0) | (F.col("pending_count") > 0), "RUNNING")
        .when(F.col("completed_count") > 0, "COMPLETED")
        .when(F.col("failed_count") > 0, "FAILED")
    )


def error_counts(trials: DataFrame) -> DataFrame:
    """Failed trials per parent and error code; UNKNOWN when only an error text exists."""
    code = F.get_json_object("error_summary", "$.code")
    named = F.coalesce(code, F.when(F.coalesce("error", F.lit("")) != "", "UNKNOWN"))
    return (
        trials.where(F.col("status") == "FAILED")
        .select("parent_run_id", named.alias("code"))
        .where(F.col("code").isNotNull())
        .groupBy("parent_run_id", "code")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def best_trials(trials: DataFrame) -> DataFrame:
    """Per parent: the completed, eligible trial with the lowest metric, then earliest end, then lowest index.

    ``min_by`` keeps one candidate per task before the shuffle, however many trials a parent has.
    """
    usable = trials.where(
        (F.col("status") == "COMPLETED") & F.col("is_eligible") & F.col("selection_metric_value").isNotNull()
    )
    order = F.struct("selection_metric_value", "completed_at", "trial_index", "model_run_id")
    return usable.groupBy("parent_run_id").agg(F.min(order).alias("_best")).select(
        "parent_run_id",
        F.col("_best.model_run_id").alias("best_trial_run_id"),
        F.col("_best.selection_metric_value").alias("best_metric_value"),
        F.lit(METRIC_NAME).alias("best_metric_name"),
    )


def model_listing(models: DataFrame, kind: str = "all", state: str = "all") -> DataFrame:
    """Models with their trial summary, filtered by kind (tuning, trial, single) and state (running, terminal)."""
    checks.one_of(kind, ("all", "tuning", "trial", "single"), "kind")
    checks.one_of(state, ("all", "running", "terminal"), "state")
    trials = trials_of(models)
    summary = trial_rollup(trials).join(best_trials(trials), "parent_run_id", "left")
    summary = summary.select(
        F.col("parent_run_id").alias("model_run_id"), "trial_count", "completed_count", "rollup_status", "best_metric_value"
    )
    rows = models.drop("best_metric_value").join(summary, "model_run_id", "left")
    rows = rows.withColumn("status", F.coalesce("rollup_status", "status")).drop("rollup_status")
    is_tuning, is_trial = F.col("trial_count").isNotNull(), F.col("parent_run_id").isNotNull()
    kinds = {"tuning": is_tuning, "trial": is_trial, "single": ~is_tuning & ~is_trial}
    states = {"running": F.col("status").isin(*UNFINISHED), "terminal": F.col("status").isin(*FINISHED)}
    if kind in kinds:
        rows = rows.where(kinds[kind])
    if state in states:
        rows = rows.where(states[state])
    return rows


def listing_order(sort_by: str = "newest") -> list:
    checks.one_of(sort_by, ("newest", "best_metric"), "sort")
    if sort_by == "newest":
        return [F.desc("created_at"), F.asc("model_run_id")]
    return [F.asc(F.coalesce("best_metric_value", "selection_metric_value", F.lit(NO_METRIC))), F.asc("model_run_id")]


def compare_models(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """Right minus left for the chosen ``pairs`` (left_id, right_id); a missing number counts as 0."""
    numbers: Sequence[str] = ("threshold", "n_components")

    def side(name: str) -> DataFrame:
        return models.select(
            F.col("model_run_id").alias(f"{name}_id"),
            *[F.coalesce(F.col(c), F.lit(0).cast(models.schema[c].dataType)).alias(f"{name}_{c}") for c in numbers],
        )

    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select(
        "left_id",
        "right_id",
        (F.col("right_threshold") - F.col("left_threshold")).alias("threshold_delta"),
        (F.col("right_n_components") - F.col("left_n_components")).alias("n_components_delta"),
    )


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row of each group in ``order``."""
    return top_rows(df, keys, order, 1).drop(RANK)
