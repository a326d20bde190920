"""The filter set shared by the analytics operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Filters:
    """Empty or None means the condition is off. Time bounds are inclusive."""

    run_id: str | None = None
    region: str | None = None
    is_anomaly: bool | None = None
    anomaly_type: str | None = None
    host_id: str | None = None
    start: str | datetime | None = None
    end: str | datetime | None = None


def time_literal(df: DataFrame, column: str, moment: str | datetime) -> Column:
    """A constant of the column's own timestamp type, so the comparison reaches the scan.

    Text without a zone, and naive datetimes, mean UTC.
    """
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    kind = df.schema[column].dataType
    text = moment.strftime("%Y-%m-%dT%H:%M:%S.%f")
    if isinstance(kind, T.TimestampType):
        text += "Z"
    return F.lit(text).cast(kind)


def between_times(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    if start:
        df = df.where(F.col(column) >= time_literal(df, column, start))
    if end:
        df = df.where(F.col(column) <= time_literal(df, column, end))
    return df


def apply_filters(df: DataFrame, filters: Filters | None) -> DataFrame:
    if filters is None:
        return df
    for name in ("run_id", "region", "anomaly_type", "host_id"):
        wanted = getattr(filters, name)
        if wanted:
            df = df.where(F.col(name) == F.lit(wanted))
    if filters.is_anomaly is not None:
        df = df.where(F.col("is_anomaly") if filters.is_anomaly else ~F.col("is_anomaly"))
    return between_times(df, "metric_timestamp", filters.start, filters.end)
