"""Dataset analytics. Every operator reports per run; pass a filtered frame for one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostvane.functions import checks
from hostvane.functions.filters import Filters, apply_filters
from hostvane.operators.joins import join_checked
from hostvane.operators.ranks import GROUP_ROWS, Quantile, aggregate
from hostvane.operators.toprows import top_rows
from hostvane.schemas import FEATURES
from hostvane.session import materialize

RUN = "run_id"
LAG_POINTS = {"lag_p50": Quantile("lag", 0.5), "lag_p95": Quantile("lag", 0.95)}


MAX_BINS = 100_000  # every run gets a row per bin


def bucket_start(column: str, seconds: int):
    """Start of the epoch-aligned bucket of ``seconds`` that holds the timestamp."""
    return F.window(F.col(column), f"{seconds} seconds")["start"]


def lag_seconds():
    micros = F.timestamp_diff("MICROSECOND", F.col("metric_timestamp"), F.col("ingestion_time"))
    return micros / F.lit(1_000_000.0)


def dataset_summary(telemetry: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows, time range, anomaly rate, distinct dimensions and ingestion lag of each run."""
    plain = [
        F.count(F.lit(1)).alias("row_count"),
        F.min("metric_timestamp").alias("min_ts"),
        F.max("metric_timestamp").alias("max_ts"),
        (F.count_if("is_anomaly") / F.count(F.lit(1))).alias("anomaly_rate"),
    ]
    rows = telemetry.select(RUN, "metric_timestamp", "is_anomaly", lag_seconds().alias("lag"))
    return aggregate(rows, [RUN], plain, LAG_POINTS, group_rows).join(distinct_counts(telemetry), RUN)


def distinct_counts(telemetry: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return telemetry.groupBy(RUN).agg(
        *[count(F.col(d)).alias(f"distinct_{d}") for d in ("host_id", "project_id", "region")]
    )


def ingest_lag(telemetry: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    lags = telemetry.select(RUN, lag_seconds().alias("lag"))
    return aggregate(lags, [RUN], [], LAG_POINTS, group_rows)


def anomaly_types(telemetry: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent anomaly types of each run; the rest are folded into ``other``."""
    checks.at_least(k, 0, "k")
    counts = (
        telemetry.where(F.col("is_anomaly") & F.col("anomaly_type").isNotNull())
        .groupBy(RUN, F.col("anomaly_type").alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    top = top_rows(counts, [RUN], [F.desc("count"), F.asc("label")], k)
    kept = top.select(RUN, "label", "count")
    sums = counts.groupBy(RUN).agg(F.sum("count").alias("_all"))
    kept_sums = kept.groupBy(RUN).agg(F.sum("count").alias("_kept"))
    other = (
        sums.join(kept_sums, RUN, "left")
        .select(RUN, F.lit("other").alias("label"), (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("count"))
        .where(F.col("count") > 0)
    )
    return kept.unionByName(other)


def anomaly_trend(telemetry: DataFrame, hours: int = 24) -> DataFrame:
    """Hourly anomaly rate over the last ``hours`` of each run's data, lower bound included."""
    newest = materialize(telemetry.groupBy(RUN).agg(F.max("metric_timestamp").alias("_newest")), "newest")
    span = F.make_dt_interval(hours=F.lit(hours))
    since = F.col("_newest") - span
    rows = telemetry.select(RUN, "metric_timestamp", "is_anomaly")
    # What is too old for every run is left out by the scan.
    oldest = newest.agg((F.min("_newest") - span).cast("string")).first()[0]
    if oldest is not None:
        rows = rows.where(F.col("metric_timestamp") >= F.lit(oldest).cast(rows.schema["metric_timestamp"].dataType))
    recent = join_checked(rows, newest, [RUN], stored=True)
    return (
        recent.where(F.col("metric_timestamp") >= since)
        .groupBy(RUN, bucket_start("metric_timestamp", 3600).alias("ts"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            (F.count_if("is_anomaly") / F.count(F.lit(1))).alias("anomaly_rate"),
        )
    )


def anomaly_trend_of_run(telemetry: DataFrame, run_id: str, hours: int = 24) -> DataFrame:
    """As ``anomaly_trend`` for one run; the newest time is a scalar subquery, so nothing is joined."""
    run = telemetry.where(F.col(RUN) == F.lit(run_id))
    since = run.select(F.max("metric_timestamp") - F.make_dt_interval(hours=F.lit(hours))).scalar()
    return (
        run.where(F.col("metric_timestamp") >= since)
        .groupBy(RUN, bucket_start("metric_timestamp", 3600).alias("ts"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            (F.count_if("is_anomaly") / F.count(F.lit(1))).alias("anomaly_rate"),
        )
    )


def top_values(
    telemetry: DataFrame, column: str, k: int = 10, filters: Filters | None = None, with_total: bool = False
) -> DataFrame:
    """The k most frequent values of a dimension per run, ``truncated`` when there are more."""
    checks.dimension(column)
    checks.at_least(k, 1, "k")
    rows = apply_filters(telemetry, filters)
    counts = rows.groupBy(RUN, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("count"))
    label = F.coalesce("_value", F.lit(""))
    named = counts.select(RUN, label.alias("label"), "count")
    head = top_rows(named, [RUN], [F.desc("count"), F.asc("label")], k + 1)
    marked = head.withColumn("truncated", F.max("_rank").over(Window.partitionBy(RUN)) > k)
    top = marked.where(F.col("_rank") <= k).drop("_rank")
    if not with_total:
        return top
    totals = rows.groupBy(RUN).agg(F.count_distinct(F.col(column)).alias("total_distinct"))
    return top.join(totals, RUN)


def series_aggregates(metrics: Sequence[str], aggs: Sequence[str]):
    """Plain aggregates and quantiles named ``metric_agg``."""
    plain, quantiles = [], {}
    simple = {"mean": F.avg, "min": F.min, "max": F.max}
    points = {"p50": 0.5, "p95": 0.95}
    for m in checks.metrics(metrics):
        for a in aggs:
            name = f"{m}_{checks.aggregation(a)}"
            if a in simple:
                plain.append(simple[a](m).alias(name))
            else:
                quantiles[name] = Quantile(m, points[a])
    return plain, quantiles


def time_series(
    telemetry: DataFrame,
    metrics: Sequence[str],
    aggs: Sequence[str] = ("mean",),
    seconds: int = 3600,
    filters: Filters | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Metrics per run and epoch-aligned bucket; empty buckets are absent."""
    checks.at_least(seconds, 1, "bucket seconds")
    plain, quantiles = series_aggregates(metrics, aggs)
    rows = apply_filters(telemetry, filters).select(
        RUN, bucket_start("metric_timestamp", seconds).alias("ts"), *dict.fromkeys(metrics)
    )
    return aggregate(rows, [RUN, "ts"], [F.count(F.lit(1)).alias("count"), *plain], quantiles, group_rows)


def histogram(
    telemetry: DataFrame,
    metric: str,
    bins: int = 40,
    low: float = 0.0,
    high: float = 0.0,
    filters: Filters | None = None,
    include_upper: bool = False,
) -> DataFrame:
    """Zero-filled counts per run and bin, with the bin's edges.

    ``high <= low`` means each run's own range, taken before the filters. Rows outside
    ``[low, high)`` are dropped; ``include_upper`` closes the last bin. As many bins are returned as are asked for, and more
    than MAX_BINS are refused.
    """
    checks.metric(metric)
    checks.at_least(bins, 1, "bins")
    checks.at_most(bins, MAX_BINS, "bins")
    if high > low:
        edges = telemetry.select(RUN).distinct().select(
            RUN, F.lit(float(low)).alias("_lo"), F.lit(float(high)).alias("_hi")
        )
    else:
        edges = telemetry.groupBy(RUN).agg(F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
    edges = materialize(edges.where(F.col("_hi") > F.col("_lo")), "edges")
    lo, hi = F.col("_lo"), F.col("_hi")
    bucket = F.width_bucket(F.col(metric), lo, hi, F.lit(bins))
    if include_upper:
        bucket = F.when(F.col(metric) == hi, F.lit(bins)).otherwise(bucket)
    counts = (
        join_checked(apply_filters(telemetry, filters).select(RUN, metric), edges, [RUN], stored=True)
        .select(RUN, (bucket - 1).cast("int").alias("bin"))
        .where(F.col("bin").between(0, bins - 1))
        .groupBy(RUN, "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    step = (hi - lo) / F.lit(float(bins))
    frame = edges.select(RUN, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, [RUN, "bin"], "left").select(
        RUN,
        "bin",
        (lo + step * F.col("bin")).alias("edge_low"),
        (lo + step * (F.col("bin") + 1)).alias("edge_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def metric_stats(telemetry: DataFrame, metrics: Sequence[str] = FEATURES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Count, range, mean, p50 and p95 of each metric, all metrics in one pass, one row per metric."""
    names = checks.metrics(metrics)
    parts = ("min", "max", "mean", "p50", "p95")
    plain, quantiles = series_aggregates(names, parts)
    wide = aggregate(
        telemetry.select(RUN, *names), [RUN], [F.count(F.lit(1)).alias("count"), *plain], quantiles, group_rows
    )
    return _per_metric(wide, names, parts, "count")


def variance_rank(telemetry: DataFrame) -> DataFrame:
    """Metrics of each run by sample standard deviation, largest first in ``rank``."""
    wide = telemetry.groupBy(RUN).agg(*[F.stddev_samp(m).alias(f"{m}_stddev") for m in FEATURES])
    long = _per_metric(wide, FEATURES, ("stddev",)).withColumn("stddev", F.coalesce("stddev", F.lit(0.0)))
    order = Window.partitionBy(RUN).orderBy(F.desc("stddev"), F.asc("metric"))
    return long.withColumn("rank", F.row_number().over(order))


def _per_metric(wide: DataFrame, metrics: Sequence[str], parts: Sequence[str], *carry: str) -> DataFrame:
    """Turn ``metric_part`` columns into one row per metric."""
    rows = [
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{p}").alias(p) for p in parts]) for m in metrics
    ]
    return wide.select(RUN, *carry, F.inline(F.array(*rows)))


def row_counts(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("is_anomaly")).alias("normal_count")
    )
