"""Stored tables changed in place: retention, deletes, roll-ups, lookups and co-located joins."""

from __future__ import annotations

import datetime as dt
import json
import os

import numpy as np
import pytest
from conftest import START, counted, reading
from pyspark.sql import functions as F

from hostvane.functions.filters import Filters
from hostvane.operators import analytics, expiry, paging, rollups, training
from hostvane.plans.stored import confusion_of
from hostvane.schemas import FEATURES
from hostvane.sources import folders
from hostvane.sources.bucketed import drop_bucketed, write_bucketed
from hostvane.sources.results import read_scores, write_scores
from hostvane.sources.telemetry import append_telemetry, read_telemetry, write_telemetry

DAY = 86400
NOW = START + dt.timedelta(days=100)
RUNS = ("r1", "r=2/ä b+%")


def rows_of(days, runs=RUNS, first=0):
    draw = np.random.default_rng(5)
    out, k = [], first
    for run in runs:
        for d in days:
            for part in range(3):
                cpu, mem, disk, rx, tx = (float(x) for x in draw.normal(50, 9, 5))
                out.append(reading(k, seconds=d * DAY + part * 4000, run=run, host=f"h{k % 7}", cpu=cpu, mem=mem, disk=disk, rx=rx, tx=tx))
                k += 1
    return out


def stored(telemetry, path, rows, **options):
    df = telemetry(rows)
    write_telemetry(df, path, "append", **options)
    return df.schema["ingestion_time"].dataType


def scores_of(spark, rows, path, models=("a", "b")):
    data = [(r["run_id"], m, r["record_id"], 1.0, False) for r in rows for m in models]
    write_scores(spark.createDataFrame(data, "dataset_id string, model_run_id string, record_id long, reconstruction_error double, predicted_is_anomaly boolean"), path)


def files_of(path):
    found = {}
    for at, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                full = os.path.join(at, n)
                found[os.path.relpath(full, path)] = (os.path.getmtime(full), os.path.getsize(full))
    return found


def ids(df, column="record_id"):
    return sorted(r[0] for r in df.select(column).collect())


def kept_after(rows, days):
    cutoff = NOW - dt.timedelta(days=days)
    return [r for r in rows if r["ingestion_time"] is None or r["ingestion_time"] >= cutoff]


@pytest.mark.parametrize("days", [47, 41, 1, 500])  # the cutoff inside a month, at the start of one, after and before all rows
def test_retention_in_place(spark, telemetry, tmp_path, days):
    rows = rows_of(range(0, 90, 3))
    rows.append(reading(9000, ingestion_time=None))
    t, s = str(tmp_path / "t"), str(tmp_path / "s")
    kind = stored(telemetry, t, rows)
    scores_of(spark, rows, s)
    before = files_of(t), files_of(s)
    expiry.expire(spark, t, s, NOW, days, str(tmp_path / "plan"), ts_type=kind)
    want = kept_after(rows, days)
    assert ids(read_telemetry(spark, t, ts_type=kind)) == sorted(r["record_id"] for r in want)
    assert ids(read_scores(spark, s)) == sorted([r["record_id"] for r in want] * 2)
    cutoff = NOW - dt.timedelta(days=days)
    after = files_of(t)
    for name, mark in before[0].items():
        month = name.split("ingest_month=")[1][:7]
        if not month.startswith("20") or month > cutoff.strftime("%Y-%m"):
            assert after[name] == mark  # neither read nor written
    if days == 500:
        assert after == before[0] and files_of(s) == before[1]
    months = {p.rsplit("=", 1)[1] for p in folders.folders(spark, f"{t}/run_id=*/ingest_month=*")}
    assert min(months) >= min(cutoff.strftime("%Y-%m"), "__H") and not os.path.exists(tmp_path / "plan" / "staged")
    expiry.expire(spark, t, s, NOW, days, str(tmp_path / "again"), ts_type=kind)  # nothing left to do
    assert ids(read_telemetry(spark, t, ts_type=kind)) == sorted(r["record_id"] for r in want)


class Broken(Exception):
    pass


def failing_at(monkeypatch, n):
    """The n-th step breaks off after its work, before its mark."""
    left, real = [n], dict(expiry.STEPS)

    def wrap(name):
        def step(spark, told):
            left[0] -= 1
            real[name](spark, told)
            if left[0] == 0:
                raise Broken

        return step

    monkeypatch.setattr(expiry, "STEPS", {name: wrap(name) for name in real})


@pytest.mark.parametrize("n", [1, 2, 3])
def test_retention_resumes_after_a_failure(spark, telemetry, tmp_path, monkeypatch, n):
    rows = rows_of(range(0, 90, 4))
    t, s, plan = str(tmp_path / "t"), str(tmp_path / "s"), str(tmp_path / "plan")
    kind = stored(telemetry, t, rows)
    scores_of(spark, rows, s)
    with monkeypatch.context() as m:
        failing_at(m, n)
        with pytest.raises(Broken):
            expiry.expire(spark, t, s, NOW, 47, plan, ts_type=kind)
    records = set(ids(read_telemetry(spark, t, ts_type=kind)))
    assert set(ids(read_scores(spark, s))) <= records  # no score without its record, at any time
    expiry.expire(spark, t, s, NOW, 47, plan, ts_type=kind)
    want = sorted(r["record_id"] for r in kept_after(rows, 47))
    assert ids(read_telemetry(spark, t, ts_type=kind)) == want
    assert ids(read_scores(spark, s)) == sorted(want * 2)
    assert expiry.resume(spark, plan) == 0


def delete_tables(spark, telemetry, folder):
    rows = rows_of(range(0, 60, 10), runs=(*RUNS, "r3"))
    paths = {n: str(folder / n) for n in ("host_telemetry_archival", "dataset_scores", "model_runs", "inference_runs", "generation_runs")}
    stored(telemetry, paths["host_telemetry_archival"], rows)
    scores_of(spark, rows, paths["dataset_scores"])
    models = [("m1", RUNS[0]), ("m2", RUNS[1]), ("m3", "r3"), ("m4", None)]
    spark.createDataFrame(models, "model_run_id string, dataset_id string").write.parquet(paths["model_runs"])
    spark.createDataFrame([("i1", "m1"), ("i2", "m3"), ("i3", "m2")], "inference_id string, model_run_id string").write.parquet(paths["inference_runs"])
    spark.createDataFrame([(r,) for r in (*RUNS, "r3")], "run_id string").write.parquet(paths["generation_runs"])
    return rows, paths


def state_of(spark, paths):
    return {n: sorted(tuple(map(str, r)) for r in spark.read.parquet(p).drop("scored_at").collect()) for n, p in paths.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_cascade_delete_resumes_after_a_failure(spark, telemetry, tmp_path, monkeypatch, n):
    rows, paths = delete_tables(spark, telemetry, tmp_path)
    gone = spark.createDataFrame([(RUNS[1],), (RUNS[1],), ("unknown",), (None,)], "dataset_id string")
    kept = {k: v for k, v in files_of(paths["host_telemetry_archival"]).items() if "run_id=r1" in k or "run_id=r3" in k}
    if n:
        with monkeypatch.context() as m:
            failing_at(m, n)
            with pytest.raises(Broken):
                expiry.delete_datasets(spark, paths, gone, str(tmp_path / "plan"))
    expiry.delete_datasets(spark, paths, gone, str(tmp_path / "plan"))
    spark.catalog.clearCache()
    left = state_of(spark, paths)
    assert {r[-2] for r in left["host_telemetry_archival"]} == {RUNS[0], "r3"}
    assert len(left["dataset_scores"]) == 2 * sum(r["run_id"] != RUNS[1] for r in rows)
    assert {r[0] for r in left["model_runs"]} == {"m1", "m3", "m4"} and {r[0] for r in left["inference_runs"]} == {"i1", "i2"}
    assert {r[0] for r in left["generation_runs"]} == {RUNS[0], "r3"}
    assert files_of(paths["host_telemetry_archival"]) == kept
    with pytest.raises(ValueError):
        expiry.plan_delete(spark, {"other": "x"}, gone, str(tmp_path / "other"))


def test_a_delete_names_only_folders_that_exist(spark, telemetry, tmp_path):
    _, paths = delete_tables(spark, telemetry, tmp_path)
    plan = str(tmp_path / "plan")
    names = [(f"unknown-{i}",) for i in range(300)]
    expiry.plan_delete(spark, paths, spark.createDataFrame([*names, (RUNS[1],), ("",), (None,)], "dataset_id string"), plan)
    steps = json.loads(folders.read_text(spark, f"{plan}/plan.json"))
    removed = {p for s in steps if s["do"] == "remove" for p in s["paths"]}
    assert removed == {
        folders.partition_folder(spark, paths["host_telemetry_archival"], run_id=RUNS[1]),
        folders.partition_folder(spark, paths["dataset_scores"], dataset_id=RUNS[1]),
    }
    assert all(folders.exists(spark, p) for p in removed)


def series(df, **options):
    out = df.collect()
    return {(r["run_id"], r["ts"]): {c: r[c] for c in df.columns if c not in ("run_id", "ts")} for r in out}


def test_rollups_read_only_what_changed(spark, telemetry, tmp_path):
    path, parts = str(tmp_path / "t"), str(tmp_path / "p")
    first, second = rows_of(range(0, 50, 2)), rows_of(range(60, 75, 3), first=5000)
    kind = stored(telemetry, path, first)
    seen = []

    def build(rows):
        seen.append(set(ids(rows)))
        return rollups.series_parts(sketches=True)(rows)

    made = rollups.refresh(spark, path, parts, build, kind)
    assert {run for run, _ in made} == set(RUNS) and len(made) == 4
    assert rollups.refresh(spark, path, parts, build, kind) == [] and len(seen) == 1
    before = files_of(f"{parts}/parts")
    append_telemetry(telemetry(second), path)
    months = {(r["run_id"], r["ingestion_time"].strftime("%Y-%m")) for r in second}
    assert set(rollups.refresh(spark, path, parts, build, kind)) == months
    assert seen[1] == {r["record_id"] for r in first + second if (r["run_id"], r["ingestion_time"].strftime("%Y-%m")) in months}
    after = files_of(f"{parts}/parts")
    assert {k for k in before if k in after and after[k] == before[k]} == {
        k for k in before if not any(m in k for _, m in months)
    }
    stored_parts = rollups.read_parts(spark, parts)
    every = telemetry(first + second)
    for seconds, filters in ((300, None), (3600, Filters(region="us")), (21600, Filters(start="2026-02-03T00:00:00", end="2026-03-05T12:00:00"))):
        got = series(rollups.rolled_series(stored_parts, ["cpu_usage", "network_tx_rate"], ["mean", "min", "max"], seconds, filters))
        rows = every
        if filters and filters.start:
            rows = rows.where("metric_timestamp < TIMESTAMP_NTZ '2026-03-05 12:00:00'")
        want = series(analytics.time_series(rows, ["cpu_usage", "network_tx_rate"], ["mean", "min", "max"], seconds, filters))
        assert got.keys() == want.keys() and got
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-12)
    quantiles = series(rollups.rolled_series(stored_parts, ["cpu_usage"], ["p50"], 604800))
    for (run, ts), r in quantiles.items():
        own = sorted(x["cpu_usage"] for x in first + second if x["run_id"] == run and ts <= x["metric_timestamp"] < ts + dt.timedelta(days=7))
        assert r["cpu_usage_p50"] == own[-(-len(own) // 2) - 1] and r["count"] == len(own)
    for bad in (Filters(start="2026-02-03T00:01:00"), Filters(host_id="h1")):
        with pytest.raises(ValueError):
            rollups.rolled_series(stored_parts, ["cpu_usage"], filters=bad)
    with pytest.raises(ValueError):
        rollups.rolled_series(stored_parts, ["cpu_usage"], seconds=450)


def test_parts_of_dropped_partitions_go(spark, telemetry, tmp_path):
    path, parts, s = (str(tmp_path / n) for n in "tps")
    rows = rows_of(range(0, 90, 5))
    kind = stored(telemetry, path, rows)
    scores_of(spark, rows[:3], s)
    rollups.refresh(spark, path, parts, rollups.distinct_parts, kind)
    expiry.expire(spark, path, s, NOW, 47, str(tmp_path / "plan"), ts_type=kind)
    rollups.refresh(spark, path, parts, rollups.distinct_parts, kind)
    left = kept_after(rows, 47)
    got = {r["run_id"]: (r["hosts"], r["projects"], r["regions"]) for r in rollups.distinct_over(rollups.read_parts(spark, parts)).collect()}
    assert got == {run: (len({r["host_id"] for r in left if r["run_id"] == run}), 1, 1) for run in RUNS}


def test_distinct_counts_keep_their_error(spark, tmp_path):
    df = spark.range(300_000).selectExpr(
        "'r' AS run_id", "'2026-02' AS ingest_month", "TIMESTAMP_NTZ '2026-02-01' + make_dt_interval(0, id % 9, 0, 0) AS metric_timestamp",
        "concat('h', id % 200000) AS host_id", "concat('p', id % 11) AS project_id", "'x' AS region",
    )
    parts = rollups.distinct_parts(df)
    got = rollups.distinct_over(parts).first()
    assert abs(got["hosts"] / 200_000 - 1) < 4 * rollups.distinct_error() and got["projects"] == 11
    some = df.where("hour(metric_timestamp) BETWEEN 2 AND 4").agg(F.count_distinct("host_id")).first()[0]
    ranged = rollups.distinct_over(parts, "2026-02-01T02:00:00", "2026-02-01T05:00:00").first()["hosts"]
    assert abs(ranged / some - 1) < 4 * rollups.distinct_error()
    with pytest.raises(ValueError):
        rollups.distinct_over(parts, "2026-02-01T02:30:00")


def test_training_from_merged_moments(spark, telemetry, tmp_path):
    path, parts = str(tmp_path / "t"), str(tmp_path / "p")
    shift = {"cpu": 1e4}  # a large mean must not cost digits
    rows = [{**r, "cpu_usage": r["cpu_usage"] + shift["cpu"]} for r in rows_of(range(0, 90, 3))] + [reading(9999, seconds=200 * DAY, run="r1")]
    kind = stored(telemetry, path, rows[:60])
    rollups.refresh(spark, path, parts, rollups.moment_parts, kind)
    append_telemetry(telemetry(rows[60:]), path)
    rollups.refresh(spark, path, parts, rollups.moment_parts, kind)
    merged = rollups.merged_moments(rollups.read_parts(spark, parts))
    every = read_telemetry(spark, path, ts_type=kind)
    direct = {r["run_id"]: r.asDict() for r in training.moments(every, ["run_id"]).collect()}
    for r in merged.collect():
        own, full = r.asDict(), direct[r["run_id"]]
        assert own.pop("run_id") == full.pop("run_id") and own == pytest.approx(full, rel=1e-9, abs=1e-9)
    got = {r["run_id"]: r["model"] for r in training.train_models(every, known=merged).collect()}
    want = {r["run_id"]: r["model"] for r in training.train_models(every).collect()}
    assert got.keys() == want.keys()
    for run in want:
        assert got[run]["thresholds"]["reconstruction_error"] == pytest.approx(want[run]["thresholds"]["reconstruction_error"], rel=1e-6)
        assert np.allclose(got[run]["model"]["components"], want[run]["model"]["components"], atol=1e-6)
    one = telemetry([reading(1)]).withColumn("ingest_month", F.lit("2026-02"))
    assert rollups.merged_moments(rollups.moment_parts(one)).first()["cov_0_0"] is None


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_colocated_joins_have_no_exchange(spark, telemetry, tmp_path):
    rows = telemetry(rows_of(range(0, 60)))
    left = write_bucketed(rows.select("run_id", "record_id", "is_anomaly"), "left_rows", 4, path=str(tmp_path / "l"))
    right = write_bucketed(rows.select("run_id", "record_id", (F.col("record_id") % 3 == 0).alias("predicted_is_anomaly")), "right_rows", 4, path=str(tmp_path / "r"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = left.join(right, ["run_id", "record_id"])
        told = plan_of(joined)
        assert "SortMergeJoin" in told and "Exchange" not in told
        assert joined.count() == 360
        want = rows.where("record_id % 3 = 0").groupBy("run_id").count()
        got = confusion_of(right, left)
        assert {(r["dataset_id"], r["fp"]) for r in got.collect()} == {(r[0], r[1]) for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("left_rows", "right_rows"):
            drop_bucketed(spark, name)


def scanned_rows(df):
    """Rows that the scan of a query without shuffles gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_lookups_open_only_row_groups_that_may_hold_the_record(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).selectExpr(
        "(id * 7919) % 40000 AS record_id", "TIMESTAMP_NTZ '2026-02-01' + make_dt_interval(0, 0, 0, id) AS metric_timestamp",
        "TIMESTAMP_NTZ '2026-02-01' + make_dt_interval(0, 0, 0, id) AS ingestion_time", "'r1' AS run_id", "'h' AS host_id",
    )
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    try:
        for name, lookups in (("plain", False), ("bloom", True)):
            write_telemetry(rows, str(tmp_path / name), "append", lookups=lookups)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    read = {}
    for name in ("plain", "bloom"):
        df = spark.read.parquet(str(tmp_path / name)).where("run_id = 'r1' AND record_id = 1234")
        assert df.count() == 1
        read[name] = scanned_rows(df.select("record_id", "host_id"))
    assert read["bloom"] < read["plain"] / 4, read


@pytest.mark.parametrize("named", [200, 0])
def test_positions_are_bounds_of_the_scan(spark, telemetry, tmp_path, named):
    path = str(tmp_path / "t")
    rows = rows_of(range(0, 30))
    kind = stored(telemetry, path, rows)
    every = read_telemetry(spark, path, ts_type=kind)
    kinds = "run_id string, last_record_id long"
    for saved in ([("r1", 40), (RUNS[1], 150)], [("r1", 40), ("r1", 50)], [("gone", 7)], [("r1", None)], []):
        df = paging.after_positions(every, spark.createDataFrame(saved, kinds), named)
        at = {}
        for run, last in saved:
            at[run] = max(at.get(run, -1), -1 if last is None else last)
        assert ids(df) == [r["record_id"] for r in rows if r["record_id"] > at.get(r["run_id"], -1)]
        assert df.columns == every.columns
    told = plan_of(paging.after_positions(every, spark.createDataFrame([("r1", 40), (RUNS[1], 150)], kinds), named))
    assert "GreaterThan(record_id,40)" in told


def test_job_listing(spark):
    from hostvane.operators import runs

    kind = "job_id string, dataset_id string, model_run_id string, status string, total_rows long, processed_rows long, created_at timestamp_ntz"
    rows = [(f"j{k}", f"d{k % 2}", f"m{k % 3}", ("PENDING", "RUNNING", "COMPLETED", "FAILED")[k % 4], 10 * k, 5 * k, START + dt.timedelta(hours=k // 2)) for k in range(12)]
    jobs = spark.createDataFrame(rows, kind)
    got = [r["job_id"] for r in runs.list_score_jobs(jobs, 3, 1, status="RUNNING").collect()]
    assert got == ["j5", "j1"]
    assert [r["job_id"] for r in runs.list_score_jobs(jobs, dataset_id="d1", model_run_id="m1").collect()] == ["j7", "j1"]
    progress = {(r["dataset_id"], r["model_run_id"]): r for r in runs.score_job_progress(jobs).collect()}
    assert progress["d0", "m0"]["jobs"] == 2 and progress["d0", "m0"]["progress"] == 0.5
    assert runs.score_job_progress(spark.createDataFrame([("j", "d", "m", "PENDING", 0, 0, START)], kind)).first()["progress"] is None
    assert counted(runs.list_score_jobs(jobs, 0)) == 0 and len(FEATURES) == 5
