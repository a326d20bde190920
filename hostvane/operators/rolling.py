"""Rolling statistics per host as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostvane.functions.detectors import OutlierConfig, WindowConfig
from hostvane.functions.pca import fixed_decimals
from hostvane.operators.sequences import POSITION, SLICE, SLICE_ROWS, HostRows, for_hosts, with_lead_in
from hostvane.schemas import FEATURES, HOST_KEYS, TIME_ORDER


def rolling_stats(
    telemetry: DataFrame, metrics: Sequence[str] = FEATURES, size: int = 60, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Mean and population deviation of each metric over the last ``size`` rows of the host, this one included."""
    last = Window.partitionBy(*HOST_KEYS, SLICE).orderBy(POSITION).rowsBetween(-(size - 1), 0)

    def build(seq: HostRows) -> DataFrame:
        stats = with_lead_in(seq, size - 1).withColumns(
            {f"{m}_mean": F.avg(m).over(last) for m in metrics}
            | {f"{m}_std": F.stddev_pop(m).over(last) for m in metrics}
        )
        wanted = [f"{m}_{s}" for m in metrics for s in ("mean", "std")]
        return stats.where(~F.col("_lead")).select(*HOST_KEYS, *TIME_ORDER, *wanted)

    return for_hosts(telemetry.select(*HOST_KEYS, *TIME_ORDER, *metrics), build, slice_rows, telemetry)


def _upper_median(sorted_values: str) -> str:
    return f"get({sorted_values}, CAST(size({sorted_values}) DIV 2 AS INT))"


def robust_z(
    telemetry: DataFrame,
    window: WindowConfig = WindowConfig(),
    outliers: OutlierConfig = OutlierConfig(),
    metrics: Sequence[str] = FEATURES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Distance of each reading from its host's rolling median, in units of the rolling MAD.

    Median and MAD come from the ``size`` rows before a recompute row, every ``recompute_interval``
    rows, and hold until the next one. Rows are therefore packed into blocks of that length, one
    median is taken per block from the blocks before it, and the blocks are unpacked again: the
    window runs over a tenth of the rows. Without poison mitigation nothing depends on earlier
    verdicts; ``operators.detect`` covers mitigation.
    """
    rows = telemetry.select(*HOST_KEYS, *TIME_ORDER, *metrics)
    return for_hosts(rows, lambda seq: _robust_z(seq, window, outliers, metrics), slice_rows, telemetry)


def _robust_z(seq: HostRows, window: WindowConfig, outliers: OutlierConfig, metrics: Sequence[str]) -> DataFrame:
    every, size, needed = window.recompute_interval, window.size, window.min_history
    rows = with_lead_in(seq, size + every)
    block = [*HOST_KEYS, SLICE, "_block"]
    packed = (
        rows.withColumn("_block", F.floor(F.col(POSITION) / every))
        .groupBy(*block)
        .agg(F.sort_array(F.collect_list(F.struct(POSITION, *TIME_ORDER, *metrics, "_lead"))).alias("_rows"))
    )
    earlier = Window.partitionBy(*HOST_KEYS, SLICE).orderBy("_block").rowsBetween(-(-(-size // every)), -1)
    packed = packed.withColumn("_before", F.flatten(F.collect_list("_rows").over(earlier)))
    if size % every:
        packed = packed.withColumn(
            "_before", F.expr(f"CASE WHEN size(_before) > {size} THEN slice(_before, -{size}, {size}) ELSE _before END")
        )
    tick = f"_block * {every} >= {needed} AND {size} >= {needed}"
    packed = packed.selectExpr(
        *HOST_KEYS, "_rows", *[f"CASE WHEN {tick} THEN sort_array(_before.{m}) END AS _h_{m}" for m in metrics]
    )
    medians = [f"{_upper_median(f'_h_{m}')} AS _m_{m}" for m in metrics]
    packed = packed.selectExpr("*", *medians).selectExpr(
        *HOST_KEYS,
        "_rows",
        *[f"_m_{m}" for m in metrics],
        *[f"sort_array(transform(_h_{m}, x -> abs(x - _m_{m}))) AS _h_{m}" for m in metrics],
    )
    # A MAD of zero is replaced by a small constant, so any departure from a flat line stands out.
    packed = packed.selectExpr(
        *HOST_KEYS,
        "inline(_rows)",
        *[f"coalesce(_m_{m}, 0.0D) AS _m_{m}" for m in metrics],
        *[f"coalesce(nullif({_upper_median(f'_h_{m}')}, 0.0D), 1e-6D) AS _d_{m}" for m in metrics],
    )
    warm = f"least({POSITION}, {size}) >= {needed}"
    judged = packed.where("NOT _lead").selectExpr(
        *HOST_KEYS,
        *TIME_ORDER,
        *[f"CASE WHEN {warm} THEN abs({m} - _m_{m}) / _d_{m} ELSE 0.0D END AS {m}_z" for m in metrics],
    )
    limit = f"{outliers.robust_z_threshold!r}D"
    flagged = ", ".join(f"CASE WHEN {m}_z > {limit} THEN {m}_z ELSE 0.0D END" for m in metrics)
    texts = [
        F.when(
            F.expr(f"{m}_z > {limit}"), F.concat(F.lit(f"{m}:rz="), fixed_decimals(F.col(f"{m}_z"), 1), F.lit(" "))
        ).otherwise("")
        for m in metrics
    ]
    return judged.withColumn("max_z", F.expr(f"array_max(array({flagged}))")).select(
        *judged.columns, (F.col("max_z") > 0).alias("is_flagged"), "max_z", F.concat(*texts).alias("details")
    )
