"""Retention and cascade delete, as tables to keep."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.functions import checks
from hostvane.functions.filters import time_literal
from hostvane.operators.joins import join_checked
from hostvane.schemas import SCORE_KEYS
from hostvane.session import materialize
from hostvane.sources.telemetry import write_telemetry

# The column that names the dataset in each dependent table.
DATASET_COLUMN = {
    "dataset_scores": "dataset_id",
    "dataset_score_jobs": "dataset_id",
    "host_telemetry_archival": "run_id",
    "alerts": "run_id",
    "model_runs": "dataset_id",
    "generation_runs": "run_id",
}


def retained_telemetry(telemetry: DataFrame, now: datetime, days: int) -> DataFrame:
    """Rows ingested within the last ``days``. Whole expired months are skipped as partitions."""
    checks.at_least(days, 0, "retention days")
    cutoff = now - timedelta(days=days)
    rows = telemetry
    if "ingest_month" in telemetry.columns:
        rows = rows.where(F.col("ingest_month") >= F.lit(cutoff.strftime("%Y-%m")))
    return rows.where(F.col("ingestion_time") >= time_literal(telemetry, "ingestion_time", cutoff))


def retained_scores(scores: DataFrame, kept: DataFrame) -> DataFrame:
    """Scores whose record is still there."""
    return scores.join(kept.select("record_id"), "record_id", "left_semi")


def apply_retention(
    telemetry: DataFrame, scores: DataFrame, now: datetime, days: int, telemetry_path: str, scores_path: str
) -> None:
    """Write what is kept to a new location; the caller swaps the locations when both writes are done."""
    write_telemetry(retained_telemetry(telemetry, now, days), telemetry_path, "errorifexists")
    written = telemetry.sparkSession.read.parquet(telemetry_path)
    left = retained_scores(scores, written).repartitionByRange(*SCORE_KEYS, "record_id")
    left.write.mode("errorifexists").partitionBy(*SCORE_KEYS).parquet(scores_path)


def without_datasets(tables: Mapping[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Every table without the datasets in ``deleted`` (one column ``dataset_id``).

    Inference runs hang off models, so they go with the models of a deleted dataset.
    """
    gone = materialize(deleted.select("dataset_id").distinct(), "deleted")
    kept = {}
    for name, column in DATASET_COLUMN.items():
        if name in tables:
            named = gone.withColumnRenamed("dataset_id", column)
            kept[name] = join_checked(tables[name], named, [column], "left_anti", stored=True)
    if "inference_runs" in tables:
        models = join_checked(tables["model_runs"], gone, ["dataset_id"], "left_semi", stored=True).select("model_run_id")
        kept["inference_runs"] = join_checked(tables["inference_runs"], models, ["model_run_id"], "left_anti")
    return kept
