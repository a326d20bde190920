"""A period against the period before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.functions.filters import Filters
from hostvane.functions.timerules import parse_iso, previous_period
from hostvane.operators.analytics import time_series
from hostvane.operators.ranks import GROUP_ROWS

KEYS = ["run_id", "ts"]


def _windows(start: str, end: str) -> tuple[str, str]:
    window = previous_period(start, end)
    if window is None:
        raise ValueError("a comparison needs a start time before its end time")
    return window


def compare_series(
    telemetry: DataFrame,
    metrics: Sequence[str],
    aggs: Sequence[str],
    seconds: int,
    start: str,
    end: str,
    filters: Filters | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Both series on the current period's time axis: ``x`` beside ``baseline_x``.

    Baseline buckets are moved forward by the period's length rounded down to whole
    buckets, so both sides keep their epoch alignment.
    """
    base_start, base_end = _windows(start, end)
    common = {**(filters.__dict__ if filters else {})}

    def series(first: str, last: str) -> DataFrame:
        return time_series(
            telemetry, metrics, aggs, seconds, Filters(**{**common, "start": first, "end": last}), group_rows
        )

    span = int((parse_iso(end) - parse_iso(start)).total_seconds())
    shift = F.make_dt_interval(secs=F.lit(span // seconds * seconds).cast("decimal(18,6)"))
    current, baseline = series(start, end), series(base_start, base_end)
    moved = baseline.select(
        "run_id",
        (F.col("ts") + shift).alias("ts"),
        *[F.col(c).alias(f"baseline_{c}") for c in baseline.columns if c not in KEYS],
    )
    return current.join(moved, KEYS, "full")


def period_delta(
    telemetry: DataFrame,
    metric: str,
    agg: str,
    seconds: int,
    start: str,
    end: str,
    filters: Filters | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Unweighted mean of bucket values now and before, their difference, and percent (NULL on zero)."""
    both = compare_series(telemetry, [metric], [agg], seconds, start, end, filters, group_rows)
    value = f"{metric}_{agg}"
    means = both.groupBy("run_id").agg(
        F.avg(value).alias("current_mean"), F.avg(f"baseline_{value}").alias("baseline_mean")
    )
    delta = F.col("current_mean") - F.col("baseline_mean")
    return means.where(F.col("current_mean").isNotNull() & F.col("baseline_mean").isNotNull()).select(
        "run_id",
        "current_mean",
        "baseline_mean",
        delta.alias("delta"),
        F.try_divide(delta * 100, F.col("baseline_mean")).alias("delta_percent"),
    )
