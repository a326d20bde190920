"""Retention and cascade delete on stored tables, by dropping partitions.

Both work in two steps. First everything that has to be written anew is written beside the tables, and a plan says in
order which folders are dropped and which partitions replaced. Then the plan is carried out; a mark is left after each of
its steps, and every step may be done twice. So a failure before the plan is written changes nothing, and after a
later one ``resume`` goes on where it stopped, to the state of a run without failures.

Whole expired months are dropped as folders, without reading them except for the ids that scores hang on. Only the month that
holds the cutoff, and the scores of models with expired records, are written anew; files of kept months are not touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvane.functions import checks
from hostvane.functions.filters import time_literal
from hostvane.operators.joins import join_checked
from hostvane.operators.lifecycle import DATASET_COLUMN
from hostvane.schemas import SCORE_KEYS
from hostvane.sources import folders
from hostvane.sources.results import read_scores
from hostvane.sources.telemetry import PARTITIONS, read_telemetry

MONTH = re.compile(r"ingest_month=(\d{4}-\d{2})$")
# The order in which dependent tables are emptied.
DELETE_ORDER = (
    "dataset_scores",
    "dataset_score_jobs",
    "host_telemetry_archival",
    "alerts",
    "inference_runs",
    "model_runs",
    "generation_runs",
)


def _remove(spark: SparkSession, step: dict) -> None:
    for path in step["paths"]:
        folders.remove(spark, path)


def _replace(spark: SparkSession, step: dict) -> None:
    """Replace the partitions of a table that the staged one has."""
    staged = spark.read.schema(T.StructType.fromJson(step["schema"])).parquet(step["from"])
    order = [c for c in (*step["by"], "metric_timestamp", "record_id") if c in staged.columns]
    (
        staged.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*step["by"])
        .parquet(step["to"])
    )


def _swap(spark: SparkSession, step: dict) -> None:
    if folders.exists(spark, step["from"]):
        folders.remove(spark, step["to"])
        folders.rename(spark, step["from"], step["to"])


STEPS: dict[str, Callable[[SparkSession, dict], None]] = {"remove": _remove, "replace": _replace, "swap": _swap}


def resume(spark: SparkSession, plan_path: str) -> int:
    """Carry out what is left of the plan at ``plan_path``; the number of steps done now. Staged tables go at the end."""
    steps = json.loads(folders.read_text(spark, f"{plan_path}/plan.json"))
    done = 0
    for k, step in enumerate(steps):
        mark = f"{plan_path}/done-{k}"
        if not folders.exists(spark, mark):
            STEPS[step["do"]](spark, step)
            folders.write_text(spark, mark, step["do"])
            done += 1
    folders.remove(spark, f"{plan_path}/staged")
    return done


def is_planned(spark: SparkSession, plan_path: str) -> bool:
    return folders.exists(spark, f"{plan_path}/plan.json")


def _write_plan(spark: SparkSession, plan_path: str, steps: list[dict]) -> None:
    folders.write_text(spark, f"{plan_path}/plan.json", json.dumps([s for s in steps if s.get("paths", True)]))


def _stage(df: DataFrame, path: str, by: list[str]) -> dict:
    """Write ``df`` partitioned beside its table."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return {"do": "replace", "from": path, "by": by, "schema": df.schema.jsonValue()}


def _emptied(spark: SparkSession, table: str, touched: DataFrame, staged: DataFrame, by: list[str]) -> list[str]:
    """Folders of the ``touched`` partitions of which no row is staged. Only names of partitions reach the driver."""
    left = staged.select(*by).distinct()
    gone = touched.join(left, by, "left_anti").toLocalIterator()
    return [folders.partition_folder(spark, table, **r.asDict()) for r in gone]


def plan_retention(
    spark: SparkSession,
    telemetry_path: str,
    scores_path: str,
    now: datetime,
    days: int,
    plan_path: str,
    ts_type: T.DataType | None = None,
) -> None:
    """Plan to drop telemetry ingested more than ``days`` before ``now``, and the scores of its records.

    Scores go first, so at no time does a score stand without its record. Rows without an ingestion time are kept.
    """
    checks.at_least(days, 0, "retention days")
    cutoff = now - timedelta(days=days)
    month = cutoff.strftime("%Y-%m")
    telemetry, scores = read_telemetry(spark, telemetry_path, ts_type=ts_type), read_scores(spark, scores_path)
    staged = f"{plan_path}/staged"
    before = F.col("ingestion_time") < time_literal(telemetry, "ingestion_time", cutoff)
    whole = F.col("ingest_month").rlike(r"^\d{4}-\d{2}$") & (F.col("ingest_month") < F.lit(month))
    boundary = telemetry.where(F.col("ingest_month") == F.lit(month))
    expired = telemetry.where(whole).select("run_id", "record_id").unionByName(boundary.where(before).select("run_id", "record_id"))
    expired.select(F.col("run_id").alias("dataset_id"), "record_id").write.mode("overwrite").parquet(f"{staged}/expired")
    gone = spark.read.parquet(f"{staged}/expired")

    touched = boundary.where(before).select(*PARTITIONS).distinct()
    touched.write.mode("overwrite").parquet(f"{staged}/months")
    touched = spark.read.parquet(f"{staged}/months")
    rest = join_checked(boundary, touched, list(PARTITIONS), "left_semi", stored=True).where(~before)
    months = _stage(rest, f"{staged}/telemetry", list(PARTITIONS)) | {"to": telemetry_path}
    old = [p for p in folders.folders(spark, f"{telemetry_path}/run_id=*/ingest_month=*") if (m := MONTH.search(p)) and m[1] < month]
    old += _emptied(spark, telemetry_path, touched, spark.read.schema(rest.schema).parquet(months["from"]), list(PARTITIONS))

    keys = ["dataset_id", "record_id"]
    models = scores.join(gone, keys, "left_semi").select(*SCORE_KEYS).distinct()
    models.write.mode("overwrite").parquet(f"{staged}/models")
    models = spark.read.parquet(f"{staged}/models")
    kept = join_checked(scores, models, list(SCORE_KEYS), "left_semi", stored=True).join(gone, keys, "left_anti")
    kept = kept.select(*scores.columns)
    replaced = _stage(kept, f"{staged}/scores", list(SCORE_KEYS)) | {"to": scores_path}
    empty = _emptied(spark, scores_path, models, spark.read.schema(kept.schema).parquet(replaced["from"]), list(SCORE_KEYS))
    _write_plan(spark, plan_path, [replaced, {"do": "remove", "paths": empty}, months, {"do": "remove", "paths": old}])


def expire(spark: SparkSession, telemetry_path: str, scores_path: str, now: datetime, days: int, plan_path: str, **options) -> None:
    """``plan_retention`` unless that was done already, and ``resume``."""
    if not is_planned(spark, plan_path):
        plan_retention(spark, telemetry_path, scores_path, now, days, plan_path, **options)
    resume(spark, plan_path)


def plan_delete(spark: SparkSession, tables: Mapping[str, str], deleted: DataFrame, plan_path: str) -> None:
    """Plan to delete every dataset in ``deleted`` (dataset_id) from the stored ``tables`` (name to path).

    Tables partitioned by dataset lose folders. The others are written anew beside themselves and swapped. Inference runs go
    with the models of a deleted dataset. The names of a table's folders reach the driver, and deleted datasets only where the
    table has a folder for them.
    """
    unknown = set(tables) - set(DELETE_ORDER)
    if unknown:
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
    gone = deleted.select("dataset_id").where("dataset_id IS NOT NULL").distinct()
    gone.write.mode("overwrite").parquet(f"{plan_path}/staged/deleted")
    gone = spark.read.parquet(f"{plan_path}/staged/deleted")
    steps = []
    for name in (n for n in DELETE_ORDER if n in tables):
        path, column = tables[name], DATASET_COLUMN.get(name)
        if column and folders.folders(spark, f"{path}/{column}=*"):
            held = spark.createDataFrame([(v,) for v in folders.partition_values(spark, path, column)], "dataset_id string")
            names = [r[0] for r in gone.join(held, "dataset_id", "left_semi").toLocalIterator()]
            steps.append({"do": "remove", "paths": [folders.partition_folder(spark, path, **{column: n}) for n in names]})
            continue
        rows = spark.read.parquet(path)
        if column:
            kept = join_checked(rows, gone.withColumnRenamed("dataset_id", column), [column], "left_anti", stored=True)
        else:
            models = spark.read.parquet(tables["model_runs"]).join(gone, "dataset_id", "left_semi").select("model_run_id")
            kept = join_checked(rows, models, ["model_run_id"], "left_anti")
        kept.select(*rows.columns).write.mode("overwrite").parquet(f"{plan_path}/staged/{name}")
        steps.append({"do": "swap", "from": f"{plan_path}/staged/{name}", "to": path})
    _write_plan(spark, plan_path, steps)


def delete_datasets(spark: SparkSession, tables: Mapping[str, str], deleted: DataFrame, plan_path: str) -> None:
    """``plan_delete`` unless that was done already, and ``resume``."""
    if not is_planned(spark, plan_path):
        plan_delete(spark, tables, deleted, plan_path)
    resume(spark, plan_path)


