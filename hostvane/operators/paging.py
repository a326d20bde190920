"""Record search, point lookups and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.functions import checks
from hostvane.functions.filters import Filters, apply_filters, time_literal
from hostvane.operators.joins import join_checked
from hostvane.operators.sequences import POSITION, number_by_ranges
from hostvane.schemas import FEATURES
from hostvane.session import materialize

SHALLOW = 5_000
POSITIONS_NAMED = 32
RECORD_COLUMNS = (
    "record_id", "host_id", "metric_timestamp", *FEATURES,
    "is_anomaly", "anomaly_type", "region", "project_id", "labels",
)


def has_more(limit: int, offset: int, returned: int, total: int | None = None) -> bool:
    return returned >= limit if total is None else offset + returned < total


def page(df: DataFrame, order: list, limit: int, offset: int = 0, shallow: int = SHALLOW) -> DataFrame:
    """``limit`` rows after ``offset`` in a total order.

    Planned as a per-task top-k while that is small. A deep page would make every task keep all rows
    before it, so its rows are numbered by ranges instead and picked by number.
    """
    checks.at_least(limit, 0, "limit")
    checks.at_least(offset, 0, "offset")
    if offset + limit <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = number_by_ranges(df.withColumn("_all", F.lit(0)), ["_all"], order, ranges)
    wanted = rows.where((F.col(POSITION) >= offset) & (F.col(POSITION) < offset + limit))
    return wanted.orderBy(POSITION).drop("_all", POSITION)


def page_summary(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row about a page: total, limit, offset, rows returned, and whether more follow."""
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - F.lit(offset)))
    counted = rows.agg(F.count(F.lit(1)).alias("total"))
    return counted.select(
        "total",
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        returned.alias("returned"),
        (F.lit(offset) + returned < F.col("total")).alias("has_more"),
    )


def page_envelope(rows: DataFrame, paged: DataFrame, limit: int, offset: int = 0) -> dict:
    """A page as the caller of a service sees it. Only ``limit`` rows reach the driver."""
    items = [r.asDict(recursive=True) for r in paged.take(limit)]
    total = rows.count()
    return {
        "items": items,
        "total": total,
        "limit": limit,
        "offset": offset,
        "returned": len(items),
        "has_more": has_more(limit, offset, len(items), total),
    }


def search_rows(
    telemetry: DataFrame,
    filters: Filters | None = None,
    sort_order: str = "desc",
    anchor: str | datetime | None = None,
) -> tuple[DataFrame, list]:
    """The matching rows and their order. An anchor keeps pages stable while rows arrive."""
    direction = checks.one_of((sort_order or "desc").lower(), ("asc", "desc"), "sort order")
    rows = apply_filters(telemetry, filters)
    if anchor:
        at = time_literal(telemetry, "metric_timestamp", anchor)
        time = F.col("metric_timestamp")
        rows = rows.where(time >= at if direction == "asc" else time <= at)
    make = F.asc if direction == "asc" else F.desc
    return rows, [make("metric_timestamp"), make("record_id")]


def search_records(
    telemetry: DataFrame,
    filters: Filters | None = None,
    limit: int = 50,
    offset: int = 0,
    sort_by: str = "metric_timestamp",
    sort_order: str = "desc",
    anchor: str | datetime | None = None,
) -> DataFrame:
    checks.one_of(sort_by or "metric_timestamp", ("metric_timestamp",), "sort column")
    rows, order = search_rows(telemetry, filters, sort_order, anchor)
    columns = [F.coalesce(c, F.lit("")).alias(c) if c == "anomaly_type" else F.col(c) for c in RECORD_COLUMNS]
    return page(rows.select(*columns), order, limit, offset)


def parsed_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.from_json("labels", "map<string,string>"))


def find_record(telemetry: DataFrame, run_id: str, record_id: int) -> DataFrame:
    found = telemetry.where((F.col("run_id") == F.lit(run_id)) & (F.col("record_id") == F.lit(record_id)))
    return parsed_labels(found.select(*FEATURES, "metric_timestamp", "host_id", "labels"))


def newest_samples(telemetry: DataFrame, run_id: str | None = None, limit: int = 20) -> DataFrame:
    rows = apply_filters(telemetry, Filters(run_id=run_id))
    return page(
        rows.select(*FEATURES, "metric_timestamp", "host_id", "record_id"),
        [F.desc("metric_timestamp"), F.desc("record_id")],
        limit,
    )


def lookup_records(telemetry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records named by ``wanted`` (run_id, record_id), labels parsed."""
    keys = ["run_id", "record_id"]
    found = telemetry.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return parsed_labels(found.select(*keys, *FEATURES, "metric_timestamp", "host_id", "labels"))


def after_record(telemetry: DataFrame, last_record_id: int) -> DataFrame:
    """Rows past a saved position, for incremental scoring."""
    return telemetry.where(F.col("record_id") > F.lit(last_record_id))


def after_positions(telemetry: DataFrame, positions: DataFrame, named: int = POSITIONS_NAMED) -> DataFrame:
    """Rows of every run past that run's saved ``last_record_id``; runs without one are read from the start.

    The scan itself skips what was read before: up to ``named`` runs with a position are read by a scan of their own with
    that bound, so finished partitions and row groups are not opened. Of more runs, the least position bounds one scan, and the others
    are joined.
    """
    saved = positions.where("last_record_id IS NOT NULL").groupBy("run_id").agg(F.max("last_record_id").alias("last_record_id"))
    saved = materialize(saved, "positions")
    known, least = saved.agg(F.count(F.lit(1)), F.min("last_record_id")).first()
    record, run = F.col("record_id"), F.col("run_id")
    if known <= named:
        rows = saved.collect()
        out = telemetry.where(~run.isin([r["run_id"] for r in rows]) | run.isNull()) if rows else telemetry
        for r in rows:
            out = out.unionAll(telemetry.where((run == F.lit(r["run_id"])) & (record > F.lit(r["last_record_id"]))))
        return out
    everywhere = join_checked(telemetry.select("run_id").distinct(), saved, ["run_id"], "left_anti", stored=True).isEmpty()
    rows = telemetry.where(record > F.lit(least)) if everywhere else telemetry
    joined = join_checked(rows, saved, ["run_id"], "left", stored=True)
    return joined.where(F.col("last_record_id").isNull() | (record > F.col("last_record_id"))).select(*telemetry.columns)
