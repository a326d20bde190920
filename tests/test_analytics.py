from __future__ import annotations

import datetime as dt

import pytest
from conftest import START, counted, reading

from hostvane.functions.filters import Filters, apply_filters
from hostvane.operators import analytics, compare, paging
from hostvane.sources.telemetry import append_telemetry, read_telemetry


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def regions(telemetry):
    kinds = ["us"] * 5 + ["eu"] * 3 + ["ap"] * 2
    data = [
        reading(i, seconds=i * 600, region=r, cpu=i, is_anomaly=i % 3 == 0, anomaly_type="SPIKE" if i % 6 == 0 else None)
        for i, r in enumerate(kinds)
    ]
    return telemetry(data).cache()


def test_top_values_truncation(regions):
    two = analytics.top_values(regions, "region", 2, with_total=True)
    assert rows_of(two, "label", "count", "truncated", "total_distinct") == [("eu", 3, True, 3), ("us", 5, True, 3)]
    five = analytics.top_values(regions, "region", 5)
    assert rows_of(five, "label", "truncated") == [("ap", False), ("eu", False), ("us", False)]


def test_top_values_shows_missing_as_empty(regions):
    top = analytics.top_values(regions, "anomaly_type", 3, with_total=True)
    assert rows_of(top, "label", "count", "total_distinct") == [("", 8, 1), ("SPIKE", 2, 1)]


def test_bad_arguments(regions):
    for call in (
        lambda: analytics.top_values(regions, "labels", 2),
        lambda: analytics.top_values(regions, "region", 0),
        lambda: analytics.time_series(regions, []),
        lambda: analytics.time_series(regions, ["cpu_usage"], ["p99"]),
        lambda: analytics.time_series(regions, ["cpu_usage"], seconds=0),
        lambda: analytics.histogram(regions, "region"),
        lambda: analytics.histogram(regions, "cpu_usage", 0),
        lambda: paging.search_records(regions, sort_by="cpu_usage"),
        lambda: paging.search_records(regions, sort_order="sideways"),
        lambda: compare.compare_series(regions, ["cpu_usage"], ["mean"], 300, "", "2026-02-01T00:00:00Z"),
    ):
        with pytest.raises(ValueError):
            call()


def test_filters_are_inclusive_and_optional(regions):
    at = lambda m: (START + dt.timedelta(minutes=m)).isoformat()
    assert counted(apply_filters(regions, Filters(start=at(10), end=at(30)))) == 3
    assert counted(apply_filters(regions, Filters(start=at(10) + "+00:00", end=START + dt.timedelta(minutes=30)))) == 3
    assert counted(apply_filters(regions, Filters(region="", anomaly_type="", start="", end=None))) == 10
    assert counted(apply_filters(regions, Filters(is_anomaly=False))) == 6
    assert counted(apply_filters(regions, Filters(is_anomaly=True, anomaly_type="SPIKE"))) == 2


def test_time_filters_follow_the_column_type(spark, regions):
    instants = regions.withColumn("metric_timestamp", regions["metric_timestamp"].cast("timestamp"))
    bounds = Filters(start=START + dt.timedelta(minutes=10), end=(START + dt.timedelta(minutes=30)).isoformat())
    assert counted(apply_filters(instants, bounds)) == counted(apply_filters(regions, bounds)) == 3


def test_summary_lag(telemetry):
    summary = analytics.dataset_summary(telemetry([reading(i) for i in range(3)])).first()
    assert summary["lag_p50"] == summary["lag_p95"] == 2.0
    assert (summary["row_count"], summary["anomaly_rate"], summary["distinct_host_id"]) == (3, 0.0, 1)


def test_empty_dataset(regions):
    none = regions.where("false")
    for df in (
        analytics.dataset_summary(none),
        analytics.anomaly_types(none),
        analytics.anomaly_trend(none),
        analytics.time_series(none, ["cpu_usage"], ["p95"]),
        analytics.histogram(none, "cpu_usage"),
        analytics.metric_stats(none),
    ):
        assert df.isEmpty()


def test_other_types_are_folded(telemetry):
    kinds = ["A"] * 3 + ["B"] * 2 + ["C", "D"]
    df = telemetry([reading(i, is_anomaly=True, anomaly_type=k) for i, k in enumerate(kinds)])
    assert rows_of(analytics.anomaly_types(df, 2), "label", "count") == [("A", 3), ("B", 2), ("other", 2)]
    assert rows_of(analytics.anomaly_types(df, 0), "label", "count") == [("other", 7)]
    assert rows_of(analytics.anomaly_types(df, 9), "label") == [("A",), ("B",), ("C",), ("D",)]


def test_histogram_edges(regions):
    df = analytics.histogram(regions, "cpu_usage", 3)
    assert rows_of(df, "bin", "edge_low", "edge_high", "count") == [(0, 0.0, 3.0, 3), (1, 3.0, 6.0, 3), (2, 6.0, 9.0, 3)]
    closed = analytics.histogram(regions, "cpu_usage", 3, include_upper=True)
    assert sum(c for _, c in rows_of(closed, "bin", "count")) == 10
    outside = analytics.histogram(regions, "cpu_usage", 4, 2.0, 6.0)
    assert rows_of(outside, "bin", "count") == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert analytics.histogram(regions.where("cpu_usage = 4"), "cpu_usage", 3).isEmpty()
    assert counted(analytics.histogram(regions, "cpu_usage", 9000)) == 9000
    with pytest.raises(ValueError, match="at most"):
        analytics.histogram(regions, "cpu_usage", analytics.MAX_BINS + 1)


def test_histogram_range_ignores_filters(regions):
    df = analytics.histogram(regions, "cpu_usage", 3, filters=Filters(region="ap"))
    assert rows_of(df, "bin", "count") == [(0, 0), (1, 0), (2, 1)]


def test_trend_bound_is_inclusive(telemetry):
    hour = 3600
    data = [reading(1, seconds=0, is_anomaly=True), reading(2, seconds=24 * hour), reading(3, seconds=-1)]
    df = telemetry(data)
    assert rows_of(analytics.anomaly_trend(df), "total", "anomaly_rate") == [(1, 0.0), (1, 1.0)]
    assert rows_of(analytics.anomaly_trend_of_run(df, "r1"), "total", "anomaly_rate") == [(1, 0.0), (1, 1.0)]


def test_period_delta(telemetry):
    day = 86400
    data = [reading(i, seconds=i * 3600, cpu=10) for i in range(24)] + [
        reading(100 + i, seconds=day + i * 3600, cpu=15) for i in range(1, 24)
    ]
    window = ("2026-02-02T00:00:00Z", "2026-02-03T00:00:00Z")
    out = compare.period_delta(telemetry(data), "cpu_usage", "mean", 3600, *window).first()
    assert (out["current_mean"], out["baseline_mean"], out["delta"], out["delta_percent"]) == (15.0, 10.0, 5.0, 50.0)
    zero = telemetry([{**r, "cpu_usage": 0.0} if r["record_id"] < 100 else r for r in data])
    assert compare.period_delta(zero, "cpu_usage", "mean", 3600, *window).first()["delta_percent"] is None


def test_pages(regions):
    rows, order = paging.search_rows(regions, Filters(run_id="r1"))
    first = paging.page_envelope(rows, paging.page(rows, order, 4), 4)
    assert [i["record_id"] for i in first["items"]] == [9, 8, 7, 6]
    assert (first["total"], first["returned"], first["has_more"]) == (10, 4, True)
    last = paging.page_envelope(rows, paging.page(rows, order, 4, 8), 4, 8)
    assert (last["returned"], last["has_more"]) == (2, False)
    deep = paging.page(rows, order, 3, 5, shallow=1)
    assert [r["record_id"] for r in deep.collect()] == [4, 3, 2]


def test_anchor_keeps_pages_stable(regions):
    anchor = START + dt.timedelta(minutes=50)
    down = paging.search_records(regions, None, 2, anchor=anchor)
    assert [r["record_id"] for r in down.collect()] == [5, 4]
    up = paging.search_records(regions, None, 2, sort_order="ASC", anchor=anchor)
    assert [r["record_id"] for r in up.collect()] == [5, 6]


def test_point_lookup(telemetry):
    df = telemetry([reading(1, labels='{"rack": "a", "n": 3}'), reading(2)])
    assert paging.find_record(df, "r1", 1).first()["labels"] == {"rack": "a", "n": "3"}
    assert paging.find_record(df, "r2", 1).isEmpty()


def test_stored_table(spark, telemetry, tmp_path):
    path = str(tmp_path / "t")
    append_telemetry(telemetry([]), path)
    assert not (tmp_path / "t").exists()
    data = [reading(i, seconds=i * 86400 * 10, run=f"r{i % 2}") for i in range(8)]
    kind = telemetry(data).schema["ingestion_time"].dataType
    append_telemetry(telemetry(data[:5]), path)
    append_telemetry(telemetry(data[5:]), path)
    stored = read_telemetry(spark, path, ts_type=kind)
    assert counted(stored) == 8
    assert {p.name for p in (tmp_path / "t" / "run_id=r0").iterdir()} == {
        "ingest_month=2026-02", "ingest_month=2026-03", "ingest_month=2026-04"
    }
    one = read_telemetry(spark, path, "r1", kind)
    assert counted(one) == 4
    assert "run_id=r1" in str(one.inputFiles()) or "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().toString()
