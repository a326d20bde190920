"""Canonical schemas and the fixed column lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature order is part of the model contract.
FEATURES = (
    "cpu_usage",
    "memory_usage",
    "disk_utilization",
    "network_rx_rate",
    "network_tx_rate",
)
NETWORK_FEATURES = ("network_rx_rate", "network_tx_rate")
DIMENSIONS = ("region", "project_id", "host_id", "anomaly_type")
ERROR_DIMENSIONS = ("anomaly_type", "region", "project_id")
AGGREGATIONS = ("mean", "min", "max", "p50", "p95")

HOST_KEYS = ("run_id", "host_id")
TIME_ORDER = ("metric_timestamp", "record_id")
SCORE_KEYS = ("dataset_id", "model_run_id")


def telemetry_schema(ts_type: T.DataType | None = None) -> T.StructType:
    ts = ts_type or T.TimestampType()
    return T.StructType(
        [
            T.StructField("record_id", T.LongType(), False),
            T.StructField("ingestion_time", ts, False),
            T.StructField("metric_timestamp", ts, False),
            T.StructField("host_id", T.StringType(), False),
            T.StructField("project_id", T.StringType(), False),
            T.StructField("region", T.StringType(), False),
            *[T.StructField(f, T.DoubleType(), False) for f in FEATURES],
            T.StructField("labels", T.StringType(), False),
            T.StructField("run_id", T.StringType(), False),
            T.StructField("is_anomaly", T.BooleanType(), False),
            T.StructField("anomaly_type", T.StringType(), True),
        ]
    )


def scores_schema(ts_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("dataset_id", T.StringType(), False),
            T.StructField("model_run_id", T.StringType(), False),
            T.StructField("record_id", T.LongType(), False),
            T.StructField("reconstruction_error", T.DoubleType(), False),
            T.StructField("predicted_is_anomaly", T.BooleanType(), False),
            T.StructField("scored_at", ts_type or T.TimestampType(), True),
        ]
    )


def alerts_schema(ts_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("host_id", T.StringType(), False),
            T.StructField("run_id", T.StringType(), False),
            T.StructField("timestamp", ts_type or T.TimestampType(), False),
            T.StructField("severity", T.StringType(), False),
            T.StructField("detector_source", T.StringType(), False),
            T.StructField("score", T.DoubleType(), False),
            T.StructField("details", T.StringType(), False),
        ]
    )


MODEL_SCHEMA = T.StructType(
    [
        T.StructField(
            "meta",
            T.StructType(
                [
                    T.StructField("version", T.StringType()),
                    T.StructField("type", T.StringType()),
                    T.StructField("features", T.ArrayType(T.StringType())),
                    T.StructField("preprocessed", T.BooleanType()),
                    T.StructField("log1p_network", T.BooleanType()),
                    T.StructField("rows_used", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "preprocessing",
            T.StructType(
                [
                    T.StructField("mean", T.ArrayType(T.DoubleType())),
                    T.StructField("scale", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField(
            "model",
            T.StructType(
                [
                    T.StructField("components", T.ArrayType(T.ArrayType(T.DoubleType()))),
                    T.StructField("explained_variance", T.ArrayType(T.DoubleType())),
                    T.StructField("mean", T.ArrayType(T.DoubleType())),
                    T.StructField("n_components", T.IntegerType()),
                ]
            ),
        ),
        T.StructField(
            "thresholds",
            T.StructType([T.StructField("reconstruction_error", T.DoubleType())]),
        ),
    ]
)
