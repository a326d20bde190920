"""Score and alert tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.schemas import SCORE_KEYS, scores_schema


def write_scores(scores: DataFrame, path: str) -> None:
    """Write scores under dataset and model. Scoring a dataset again replaces its scores.

    Ranges of record ids spread a dataset of any size over the writing tasks.
    """
    if "scored_at" not in scores.columns:
        scores = scores.withColumn("scored_at", F.current_timestamp())
    (
        scores.repartitionByRange(*SCORE_KEYS, "record_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SCORE_KEYS)
        .parquet(path)
    )


def read_scores(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    df = spark.read.schema(scores_schema()).parquet(path)
    return df.where(F.col("dataset_id") == F.lit(dataset_id)) if dataset_id else df


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").partitionBy("run_id").parquet(path)
