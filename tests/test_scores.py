from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import START, counted, reading
from pyspark.sql import functions as F

from hostvane.operators import lifecycle, runs, scores
from hostvane.sources.results import append_alerts, read_scores, write_scores


@pytest.fixture(scope="module")
def scored(spark, telemetry):
    """(scores, telemetry): 60 records, rounded errors so thresholds tie, a few records gone."""
    draw = np.random.default_rng(5)
    data = [reading(i, is_anomaly=bool(draw.random() < 0.3), anomaly_type="X" if i % 2 else None) for i in range(60)]
    errors = np.round(draw.lognormal(0, 1, 60), 1)
    rows = [("r1", "m1", i, float(e), bool(e > 1.5)) for i, e in enumerate(errors)]
    rows += [("r1", "m1", 1000 + i, 50.0 + i, True) for i in range(3)]
    df = spark.createDataFrame(
        rows,
        "dataset_id string, model_run_id string, record_id long, reconstruction_error double, predicted_is_anomaly boolean",
    )
    return df.cache(), telemetry(data).cache()


def brute_curves(samples, points):
    ordered = sorted(samples, key=lambda s: -s[0])
    p, n = sum(label for _, label in samples), sum(not label for _, label in samples)
    out = []
    for i in range(points):
        threshold = ordered[int(i / (points - 1) * (len(ordered) - 1))][0]
        tp = sum(label for e, label in samples if e >= threshold)
        fp = sum(not label for e, label in samples if e >= threshold)
        out.append((i, threshold, fp / n, tp / p, tp / (tp + fp)))
    return out


@pytest.mark.parametrize("points, used", [(0, 50), (3, 3), (25, 25), (400, 400)])
@pytest.mark.parametrize("group_rows", [1000, 5])
def test_curves_equal_brute_force(scored, points, used, group_rows):
    labelled = scores.labelled_scores(*scored)
    samples = [(r["reconstruction_error"], r["label"]) for r in labelled.collect()]
    got = scores.curves(labelled, points, group_rows).orderBy("point").collect()
    want = brute_curves(samples, used)
    assert len(got) == used
    for g, w in zip(got, want):
        assert (g["point"], g["threshold"], g["fpr"], g["tpr"], g["precision"]) == pytest.approx(w)
        assert g["recall"] == g["tpr"]
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(got, got[1:]))


def test_points_are_honoured_or_refused():
    assert [scores.curve_points(n) for n in (0, 2, 5, 1000)] == [50, 2, 5, 1000]
    for n in (-1, 1, 1001):
        with pytest.raises(ValueError):
            scores.curve_points(n)


def test_curves_without_positives(scored):
    labelled = scores.labelled_scores(*scored).withColumn("label", F.lit(False))
    got = scores.curves(labelled, 10).collect()
    assert all(g["tpr"] == g["precision"] == 0.0 for g in got)


def test_confusion_covers_all_rows(scored):
    row = scores.confusion(scores.labelled_scores(*scored)).first()
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == 60


def test_browse_skips_orphans(scored):
    page = scores.browse_scores(*scored, limit=5).collect()
    assert all(r["record_id"] < 60 for r in page)
    errors = [(-r["reconstruction_error"], -r["record_id"]) for r in page]
    assert errors == sorted(errors)
    assert counted(scores.orphaned_scores(*scored)) == 3
    summary = scores.browse_summary(*scored, only_anomalies=True, min_score=2.0).first()
    assert (summary["orphans"], summary["max_score"]) == (3, 52.0)
    assert summary["total"] == counted(scores.score_filter(scored[0], True, 2.0))


def test_zero_is_a_usable_bound(scored):
    assert counted(scores.score_filter(scored[0], max_score=0.0)) == counted(scored[0].where("reconstruction_error <= 0"))


def test_range_of_unscored_model(scored):
    row = scores.score_range_of(scored[0], "r1", "none").first()
    assert (row["min_score"], row["max_score"]) == (0.0, 10.0)
    assert scores.score_range_of(scored[0], "r1", "m1").first()["max_score"] == 52.0


def test_distribution_labels(scored):
    got = {r["label"]: r["count"] for r in scores.error_distribution(*scored, "anomaly_type").collect()}
    assert got == {"": 30, "X": 30}
    with pytest.raises(ValueError):
        scores.error_distribution(*scored, "host_id")


def test_rescoring_replaces_only_its_own(spark, scored, tmp_path):
    path = str(tmp_path / "s")
    other = scored[0].selectExpr("'r2' AS dataset_id", "model_run_id", "record_id", "reconstruction_error", "predicted_is_anomaly")
    for df in (scored[0], other, scored[0].where("record_id < 10")):
        write_scores(df, path)
    assert {r[0]: r[1] for r in read_scores(spark, path).groupBy("dataset_id").count().collect()} == {"r1": 10, "r2": 63}
    assert counted(read_scores(spark, path, "r2")) == 63


def models(spark, rows):
    names = (
        "model_run_id string, parent_run_id string, status string, trial_index int, is_eligible boolean, "
        "selection_metric_value double, completed_at timestamp_ntz, created_at timestamp_ntz, error string, error_summary string"
    )
    return spark.createDataFrame(rows, names)


def trial(i, status="COMPLETED", metric=1.0, ok=True, ended=0, parent="p", error=None, summary=None):
    done = START + dt.timedelta(seconds=ended)
    return (f"{parent}-{i}", parent, status, i, ok, metric, done, START, error, summary)


@pytest.mark.parametrize(
    "trials, best",
    [
        ([trial(0, metric=2.0), trial(1, metric=1.0)], "p-1"),
        ([trial(0, ended=9), trial(1, ended=3), trial(2, ended=5)], "p-1"),
        ([trial(2, ended=3), trial(1, ended=3)], "p-1"),
        ([trial(0, metric=0.5, ok=False), trial(1)], "p-1"),
        ([trial(0, "FAILED", 0.1), trial(1), trial(2, metric=None)], "p-1"),
        ([trial(0, "RUNNING")], None),
    ],
)
def test_best_trial(spark, trials, best):
    found = [r["best_trial_run_id"] for r in runs.best_trials(models(spark, trials)).collect()]
    assert found == ([best] if best else [])


@pytest.mark.parametrize(
    "states, want",
    [
        (["RUNNING", "COMPLETED"], "RUNNING"),
        (["PENDING", "FAILED"], "RUNNING"),
        (["COMPLETED", "FAILED"], "COMPLETED"),
        (["FAILED"], "FAILED"),
        (["CANCELLED"], None),
    ],
)
def test_parent_status(spark, states, want):
    rolled = runs.trial_rollup(models(spark, [trial(i, s) for i, s in enumerate(states)])).first()
    assert (rolled["rollup_status"], rolled["trial_count"]) == (want, len(states))


def test_error_codes(spark):
    df = models(
        spark,
        [
            trial(0, "FAILED", summary='{"code": "E_DB"}'),
            trial(1, "FAILED", error="boom"),
            trial(2, "FAILED", error=""),
            trial(3, "FAILED"),
            trial(4, "COMPLETED", error="late"),
        ],
    )
    assert {r["code"]: r["count"] for r in runs.error_counts(df).collect()} == {"E_DB": 1, "UNKNOWN": 1}


def test_listing_kinds(spark):
    parent = ("p", None, "RUNNING", None, True, None, None, START, None, None)
    single = ("s", None, "PENDING", None, True, 7.0, None, START + dt.timedelta(1), None, None)
    df = models(spark, [parent, single, trial(0, metric=3.0), trial(1, "FAILED", metric=None)])
    ids = lambda kind, state="all": {r["model_run_id"] for r in runs.model_listing(df, kind, state).collect()}
    assert ids("tuning") == {"p"} and ids("trial") == {"p-0", "p-1"} and ids("single") == {"s"}
    assert ids("all", "running") == {"s"} and ids("all", "terminal") == {"p", "p-0", "p-1"}
    order = [r["model_run_id"] for r in runs.model_listing(df).orderBy(*runs.listing_order("best_metric")).collect()]
    assert order == ["p", "p-0", "s", "p-1"]
    assert runs.model_listing(df).orderBy(*runs.listing_order()).first()["model_run_id"] == "s"
    with pytest.raises(ValueError):
        runs.model_listing(df, "grid")
    trials = runs.list_trials(df, "p", 1, 1).collect()
    assert [t["model_run_id"] for t in trials] == ["p-1"]


def test_retention(spark, scored, telemetry, tmp_path):
    now = START + dt.timedelta(days=30)
    data = telemetry([reading(i, seconds=i * 86400) for i in range(30)])
    kept = lifecycle.retained_telemetry(data, now, 10)
    assert sorted(r["record_id"] for r in kept.collect()) == list(range(20, 30))
    lifecycle.apply_retention(data, scored[0], now, 10, str(tmp_path / "t"), str(tmp_path / "s"))
    assert counted(spark.read.parquet(str(tmp_path / "t"))) == 10
    assert {r["record_id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()} == set(range(20, 30))


def test_cascade_delete(spark, scored, telemetry):
    infer = spark.createDataFrame([("i1", "a"), ("i2", "b")], "inference_id string, model_run_id string")
    own = spark.createDataFrame([("a", "r1"), ("b", "r2")], "model_run_id string, dataset_id string")
    gone = spark.createDataFrame([("r1",), ("r1",)], "dataset_id string")
    tables = {"dataset_scores": scored[0], "host_telemetry_archival": scored[1], "model_runs": own, "inference_runs": infer}
    left = lifecycle.without_datasets(tables, gone)
    assert {n: counted(df) for n, df in left.items()} == {
        "dataset_scores": 0, "host_telemetry_archival": 0, "model_runs": 1, "inference_runs": 1
    }


def test_alert_table_grows(spark, tmp_path):
    alert = spark.createDataFrame([("h", "r1", START, "HIGH", "X", 1.0, "d")], "host_id string, run_id string, timestamp timestamp_ntz, severity string, detector_source string, score double, details string")
    for _ in range(2):
        append_alerts(alert, str(tmp_path / "a"))
    assert counted(spark.read.parquet(str(tmp_path / "a"))) == 2
