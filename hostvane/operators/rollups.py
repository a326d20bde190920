"""Stored parts of aggregates, kept per run and ingestion month and refreshed where telemetry changed.

A part is a mergeable piece of an aggregate over one stored partition: sums and extremes of 300-second buckets, moments for
training, or sketches of distinct values per hour. Queries merge parts and never read telemetry. ``refresh`` compares
the files of every telemetry partition with those its part was made from, and makes only changed parts anew; parts of
partitions that are gone go too. All bucket widths in use are multiples of 300 seconds, so one table of parts serves
them all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvane.functions import checks
from hostvane.functions.filters import Filters, time_literal
from hostvane.functions.timerules import parse_iso
from hostvane.operators.analytics import bucket_start
from hostvane.operators.training import PAIRS, moments
from hostvane.schemas import FEATURES
from hostvane.session import materialize
from hostvane.sources import folders
from hostvane.sources.telemetry import PARTITIONS, read_telemetry

STEP = 300
KLL_K = 400
HLL_LG_K = 15
LISTED = 500  # partitions named one by one in a scan's filter; of more, only their months are
SIMPLE = {"mean", "min", "max"}
POINTS = {"p50": 0.5, "p95": 0.95}
DISTINCT = {"hosts": "host_id", "projects": "project_id", "regions": "region"}
STATE_SCHEMA = "run_id string, ingest_month string, files long, digest long"

Build = Callable[[DataFrame], DataFrame]


def _unescaped(part: str) -> Column:
    """A partition's value out of a path, as Spark escapes it."""
    raw = F.regexp_extract("path", f"/{part}=([^/]*)/", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def fingerprints(spark: SparkSession, telemetry_path: str) -> DataFrame:
    """(run_id, ingest_month, files, digest) of every stored partition, from names, sizes and times of files; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(telemetry_path)
    named = files.select(*[_unescaped(p).alias(p) for p in PARTITIONS], F.xxhash64("path", "length", "modificationTime").alias("mark"))
    return named.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("files"), F.bit_xor("mark").alias("digest"))


def _latest_state(spark: SparkSession, parts_path: str) -> tuple[int, DataFrame]:
    versions = [int(p.rsplit("=", 1)[1]) for p in folders.folders(spark, f"{parts_path}/state/version=*")]
    done = [v for v in versions if folders.exists(spark, f"{parts_path}/state/version={v}/_SUCCESS")]
    if not done:
        return max(versions, default=0), spark.createDataFrame([], STATE_SCHEMA)
    return max(versions), spark.read.schema(STATE_SCHEMA).parquet(f"{parts_path}/state/version={max(done)}")


def _named(partitions: Sequence[tuple[str, str]]) -> Column:
    """A filter that prunes to these partitions."""
    if len(partitions) > LISTED:
        return F.col("ingest_month").isin(sorted({month for _, month in partitions}))
    wanted = F.lit(False)
    for run, month in partitions:
        wanted |= (F.col("run_id") == F.lit(run)) & (F.col("ingest_month") == F.lit(month))
    return wanted


def refresh(
    spark: SparkSession, telemetry_path: str, parts_path: str, build: Build, ts_type: T.DataType | None = None
) -> list[tuple[str, str]]:
    """Bring the parts at ``parts_path`` up to date; the partitions made anew. A failure leaves them to the next call.

    ``build`` gets rows of telemetry with ``ingest_month`` and returns parts that keep both partition columns. Names of changed
    partitions reach the driver, nothing else.
    """
    now = materialize(fingerprints(spark, telemetry_path), "fingerprints")
    version, seen = _latest_state(spark, parts_path)
    keys = list(PARTITIONS)
    changed = now.join(seen, [*keys, "files", "digest"], "left_anti")
    partitions = sorted((r["run_id"], r["ingest_month"]) for r in changed.toLocalIterator())
    vanished = seen.join(now, keys, "left_anti").toLocalIterator()
    gone = [folders.partition_folder(spark, f"{parts_path}/parts", run_id=r["run_id"], ingest_month=r["ingest_month"]) for r in vanished]
    if partitions:
        rows = read_telemetry(spark, telemetry_path, ts_type=ts_type).where(_named(partitions))
        if len(partitions) > LISTED:
            rows = rows.join(F.broadcast(spark.createDataFrame(partitions, "run_id string, ingest_month string")), keys, "left_semi")
        made = build(rows).repartition(*keys)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{parts_path}/parts")
    for path in gone:
        folders.remove(spark, path)
    if partitions or gone:
        now.write.mode("overwrite").parquet(f"{parts_path}/state/version={version + 1}")
        for old in range(max(1, version - 1), version):
            folders.remove(spark, f"{parts_path}/state/version={old}")
    return partitions


def read_parts(spark: SparkSession, parts_path: str) -> DataFrame:
    # Partition values are text, whatever they look like.
    df = spark.read.option("basePath", f"{parts_path}/parts").parquet(f"{parts_path}/parts")
    kinds = T.StructType([f for f in df.schema if f.name not in PARTITIONS] + [T.StructField(p, T.StringType()) for p in PARTITIONS])
    return spark.read.schema(kinds).parquet(f"{parts_path}/parts")


# ---- 300-second series


def series_parts(sketches: bool = False) -> Build:
    """Counts, sums and extremes per 300 seconds, region and anomaly type; with ``sketches``, also of quantiles."""

    def build(rows: DataFrame) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("count")]
        for m in FEATURES:
            aggs += [F.sum(m).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
            if sketches:
                aggs.append(F.expr(f"kll_sketch_agg_double({m}, {KLL_K})").alias(f"{m}_kll"))
        at = bucket_start("metric_timestamp", STEP).alias("ts")
        return rows.groupBy(*PARTITIONS, at, "region", "is_anomaly", "anomaly_type").agg(*aggs)

    return build


def _aligned(moment, what: str):
    parsed = parse_iso(moment) if isinstance(moment, str) else moment
    if parsed is None or (parsed.hour * 3600 + parsed.minute * 60 + parsed.second) % STEP:
        raise ValueError(f"{what} must be a time on a {STEP}-second mark, got {moment!r}")
    return moment


def rolled_series(
    parts: DataFrame, metrics: Sequence[str], aggs: Sequence[str] = ("mean",), seconds: int = 3600, filters: Filters | None = None
) -> DataFrame:
    """As ``analytics.time_series``, from parts. Widths are multiples of 300 seconds; ``start`` is included and ``end`` is not, both
    on 300-second marks. ``p50`` and ``p95`` need parts with sketches and are nearest ranks within KLL's error, exact in small buckets.
    """
    checks.at_least(seconds, STEP, "bucket seconds")
    if seconds % STEP:
        raise ValueError(f"bucket seconds must be a multiple of {STEP}")
    f = filters or Filters()
    if f.host_id:
        raise ValueError("parts are not kept per host")
    rows = parts.where(F.col("run_id") == F.lit(f.run_id)) if f.run_id else parts
    for column, wanted in (("region", f.region), ("anomaly_type", f.anomaly_type), ("is_anomaly", f.is_anomaly)):
        if wanted not in (None, ""):
            rows = rows.where(F.col(column) == F.lit(wanted))
    if f.start:
        rows = rows.where(F.col("ts") >= time_literal(parts, "ts", _aligned(f.start, "start")))
    if f.end:
        rows = rows.where(F.col("ts") < time_literal(parts, "ts", _aligned(f.end, "end")))
    out = []
    for m in checks.metrics(metrics):
        for a in aggs:
            name = f"{m}_{checks.aggregation(a)}"
            if a == "mean":
                out.append((F.sum(f"{m}_sum") / F.sum("count")).alias(name))
            elif a in SIMPLE:
                out.append({"min": F.min, "max": F.max}[a](f"{m}_{a}").alias(name))
            else:
                merged = f"kll_merge_agg_double({m}_kll)"
                out.append(F.expr(f"kll_sketch_get_quantile_double({merged}, {POINTS[a]}D)").alias(name))
    return rows.groupBy("run_id", bucket_start("ts", seconds).alias("ts")).agg(F.sum("count").alias("count"), *out)


def rolled_anomaly_rate(parts: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows and anomaly rate per run and bucket."""
    bad = F.sum(F.when(F.col("is_anomaly"), F.col("count")).otherwise(0))
    return parts.groupBy("run_id", bucket_start("ts", seconds).alias("ts")).agg(
        F.sum("count").alias("total"), (bad / F.sum("count")).alias("anomaly_rate")
    )


# ---- moments


def moment_parts(rows: DataFrame) -> DataFrame:
    """Rows, means and sums of products of deviations per partition."""
    found = moments(rows, PARTITIONS)
    products = [F.coalesce(F.col(f"cov_{i}_{j}") * (F.col("n") - 1), F.lit(0.0)).alias(f"m2_{i}_{j}") for i, j in PAIRS]
    return found.select(*PARTITIONS, "n", *[f"mean_{f}" for f in FEATURES], *products)


def merged_moments(parts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """What ``training.moments`` gives over all rows, from parts of them.

    Parts are merged by their distance from the common mean, so nothing large cancels.
    """
    keys = list(keys)
    means = parts.groupBy(*keys).agg(
        F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.col(f"mean_{f}")) / F.sum("n")).alias(f"_mean_{f}") for f in FEATURES]
    )
    apart = [(F.col(f"mean_{f}") - F.col(f"_mean_{f}")) for f in FEATURES]
    joined = parts.join(means, keys)
    return joined.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        *[F.first(f"_mean_{f}").alias(f"mean_{f}") for f in FEATURES],
        *[
            F.try_divide(F.sum(F.col(f"m2_{i}_{j}") + F.col("n") * apart[i] * apart[j]), F.first("_n") - 1).alias(f"cov_{i}_{j}")
            for i, j in PAIRS
        ],
    )


# ---- distinct values


def distinct_parts(rows: DataFrame) -> DataFrame:
    """Sketches of the distinct hosts, projects and regions per run and hour."""
    at = bucket_start("metric_timestamp", 3600).alias("ts")
    sketches = [F.hll_sketch_agg(column, F.lit(HLL_LG_K)).alias(name) for name, column in DISTINCT.items()]
    return rows.groupBy(*PARTITIONS, at).agg(*sketches)


def distinct_over(parts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(run_id, hosts, projects, regions) between two full hours, ``end`` excluded.

    Estimates: the relative standard error is ``distinct_error()``, and a few thousand values are counted exactly.
    """
    rows = parts
    for moment, able in ((start, F.col("ts").__ge__), (end, F.col("ts").__lt__)):
        if moment:
            parsed = parse_iso(moment)
            if parsed is None or parsed.minute or parsed.second:
                raise ValueError(f"expected a full hour, got {moment!r}")
            rows = rows.where(able(time_literal(parts, "ts", moment)))
    return rows.groupBy("run_id").agg(*[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in DISTINCT])


def distinct_error() -> float:
    return 1.04 / float(np.sqrt(2**HLL_LG_K))
