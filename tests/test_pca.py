from __future__ import annotations

import numpy as np
import pytest
from conftest import by_record, reading

from hostvane.functions.features import preprocess, project_json_samples
from hostvane.functions.pca import DEFAULT_MODEL, PcaModel, score, score_details
from hostvane.operators.training import train, train_models
from hostvane.operators.tuning import Sweep, run_sweep
from hostvane.schemas import FEATURES
from hostvane.sources.artifacts import read_model, write_model, write_models

# Published samples and their errors under the default model.
GOLDEN = [
    ([22.733602246716966, 28.23827074251183, 16.862884452848604, 776.0130772286886, 619.9309686400511], 26.65281565458167),
    ([31.675833970975287, 6.808768948794574, 24.014405840168784, 868.2708629262477, 43.779481202119605], 55.128923504013294),
    ([79.73654573327342, 61.68289772563805, 78.00078563342119, 477.1582515867283, 219.72537375712653], 4.525846962756929),
    ([67.62546707509746, 17.632632028120344, 20.376759615561234, 168.84864042232493, 203.82871431249316], 15.275248396966711),
    ([39.110955060190896, 30.43883872195896, 55.20509547616217, 533.9773211451657, 981.1735029508034], 90.97553946085603),
    ([33.281392786638456, 44.0886810876118, 36.69941420516675, 425.83187682655256, 44.549881899107355], 23.898289591002037),
]


def reconstruct(x, model):
    """The model's arithmetic step by step."""
    scaled = (np.array(x) - model.mean) / model.scale
    centered = scaled - np.array(model.pca_mean)
    axes = np.array(model.components)
    return centered - axes.T @ (axes @ centered)


def rows(telemetry, samples):
    return telemetry([reading(i, **dict(zip(("cpu", "mem", "disk", "rx", "tx"), x))) for i, x in enumerate(samples)])


def test_golden_samples(telemetry):
    scored = by_record(score(rows(telemetry, [x for x, _ in GOLDEN]), DEFAULT_MODEL), "reconstruction_error", "predicted_is_anomaly")
    for i, (_, error) in enumerate(GOLDEN):
        assert scored[i][0] == pytest.approx(error, abs=1e-5)
        assert scored[i][1] is True


def test_rows_near_the_mean_are_normal(telemetry):
    samples = [[m + d * s for m, s in zip(DEFAULT_MODEL.mean, DEFAULT_MODEL.scale)] for d in (-1.0, 0.0, 0.5, 1.0)]
    scored = by_record(score(rows(telemetry, samples), DEFAULT_MODEL), "reconstruction_error", "predicted_is_anomaly")
    for i, x in enumerate(samples):
        assert scored[i][0] == pytest.approx(np.linalg.norm(reconstruct(x, DEFAULT_MODEL)), abs=1e-9)
        assert scored[i][1] is False


def test_residuals_and_top_contributor(telemetry):
    scored = score(rows(telemetry, [GOLDEN[0][0]]), DEFAULT_MODEL, residuals=True).first()
    want = reconstruct(GOLDEN[0][0], DEFAULT_MODEL)
    assert scored["residuals"] == pytest.approx(list(want), abs=1e-9)
    assert scored["top_contributor"] == FEATURES[int(np.argmax(np.abs(want)))]


def test_details_text(spark):
    draw = np.random.default_rng(0)
    errors = [1.0, 1.5, 26.65281565458167, 123456.7, 2.0, 999999.5, 999999.4, 1e6, 1.2e6, 2.5951e7, 1e300]
    errors += [float(x) for x in 10 ** draw.uniform(0.1, 12, 200)]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(errors)], "record_id int, reconstruction_error double")
    texts = by_record(df.select("record_id", score_details(1.1971291001486588).alias("d")), "d")
    want = [None] + [f"PCA_RECON_ERR={e:g} > 1.19713" for e in errors[1:]]
    assert [texts[i] for i in range(len(errors))] == want
    small = [0.0, 3e-5, 3.4e-5, 1e-15, 1.2e-15, 1e-4, 9.999995e-5, 9.99999e-5, 0.00012345678, 0.5, 1.0]
    small += [float(x) for x in 10 ** draw.uniform(-20, 0, 200)]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(small)], "record_id int, reconstruction_error double")
    texts = by_record(df.select("record_id", score_details(-1.0).alias("d")), "d")
    assert [texts[i] for i in range(len(small))] == [f"PCA_RECON_ERR={e:g} > -1" for e in small]


def test_filters_reach_the_scan_and_scores_are_computed_once(spark, tmp_path, telemetry):
    rows(telemetry, [x for x, _ in GOLDEN]).write.parquet(str(tmp_path / "t"))
    plan = score(spark.read.parquet(str(tmp_path / "t")), DEFAULT_MODEL).where(
        "run_id = 'r1' AND reconstruction_error > 2 AND predicted_is_anomaly"
    )._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run_id,r1)" in plan
    assert plan.lower().count("sqrt(") == 1


def test_preprocess(telemetry):
    df = telemetry([reading(1, cpu=-1, mem=-2, disk=-3, rx=-4, tx=-5), reading(2, rx=100, tx=0)])
    plain = by_record(preprocess(df), *FEATURES)
    assert plain[1] == (0.0, 0.0, 0.0, 0.0, 0.0) and plain[2][3:] == (100.0, 0.0)
    logged = by_record(preprocess(df, log1p_network=True), *FEATURES)
    assert logged[2][3] == pytest.approx(np.log1p(100)) and logged[2][4] == 0.0


def test_json_samples(spark):
    body = '[{"cpu_usage": 1.5, "network_tx_rate": 2}, {}, {"disk_utilization": 7.25, "other": 1}]'
    df = spark.createDataFrame([("a", body)], "id string, samples string")
    got = [tuple(r) for r in project_json_samples(df, "samples", "id").orderBy("sample_index").collect()]
    assert got == [("a", 0, 1.5, 0.0, 0.0, 0.0, 2.0), ("a", 1, *[0.0] * 5), ("a", 2, 0.0, 0.0, 7.25, 0.0, 0.0)]


def correlated(i):
    b = i % 50
    cpu, rx = 40 + b, 50 + 0.5 * b
    return [cpu, 0.8 * cpu + 5, 30 + i % 3, rx, 0.5 * rx + 2]


def brute_force(samples, k, percentile):
    x = np.array(samples, dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0, ddof=1)
    scale[scale == 0] = 1.0
    scaled = (x - mean) / scale
    values, vectors = np.linalg.eigh(np.cov(scaled, rowvar=False))
    axes = vectors[:, np.argsort(-values)[:k]].T
    errors = np.sort(np.linalg.norm(scaled - scaled @ axes.T @ axes, axis=1))
    place = max(int(np.ceil(percentile / 100 * len(errors))) - 1, 0)
    return mean, scale, np.sort(values)[::-1][:k], errors[place]


@pytest.mark.parametrize("k, percentile", [(3, 99.5), (1, 90.0), (2, 50.0)])
def test_training_equals_brute_force(telemetry, k, percentile):
    samples = [correlated(i) for i in range(200)]
    model = train(rows(telemetry, samples), k, percentile)
    mean, scale, variances, threshold = brute_force(samples, k, percentile)
    assert len(model.mean) == len(model.scale) == len(model.pca_mean) == 5
    assert np.array(model.components).shape == (k, 5) and model.rows_used == 200
    np.testing.assert_allclose(model.mean, mean)
    np.testing.assert_allclose(model.scale, scale)
    np.testing.assert_allclose(model.explained_variance, variances, atol=1e-9)
    assert model.threshold == pytest.approx(threshold, abs=1e-9) and model.threshold >= 0
    for axis in model.components:
        assert max(axis, key=abs) > 0


def test_training_with_constant_feature(telemetry):
    samples = [[i, 2 * i + i % 7, 30.0, i % 5, i % 3] for i in range(60)]
    model = train(rows(telemetry, samples), 2, 95.0)
    assert model.scale[2] == 1.0
    assert model.threshold == pytest.approx(brute_force(samples, 2, 95.0)[3], abs=1e-9)


@pytest.mark.parametrize("k", [0, 6, -1])
def test_component_bounds(telemetry, k):
    with pytest.raises(ValueError):
        train(rows(telemetry, [correlated(i) for i in range(3)]), k)


def test_one_row_is_not_enough(telemetry):
    with pytest.raises(ValueError):
        train(rows(telemetry, [correlated(0)]))


def test_normal_only(telemetry):
    data = [reading(i, cpu=c, mem=m, disk=d, rx=r, tx=t, is_anomaly=i >= 50) for i, (c, m, d, r, t) in enumerate(map(correlated, range(60)))]
    assert train(telemetry(data), normal_only=True).rows_used == 50


def test_artifact_round_trip(spark, telemetry, tmp_path):
    samples = [[10 + i, 20 + 0.5 * i, 30 + i % 5, 40 + 0.2 * i, 50 + 0.1 * i] for i in range(50)]
    model = train(rows(telemetry, samples), preprocessed=True, log1p_network=True)
    write_model(spark, model, str(tmp_path / "m"))
    assert read_model(spark, str(tmp_path / "m")) == model


def test_many_models_are_written(spark, telemetry, tmp_path):
    data = [reading(i, run=f"r{i % 3}", **dict(zip(("cpu", "mem", "disk", "rx", "tx"), correlated(i)))) for i in range(90)]
    write_models(train_models(telemetry(data)), str(tmp_path / "m"))
    stored = spark.read.json(str(tmp_path / "m"))
    assert {r["run_id"] for r in stored.collect()} == {"r0", "r1", "r2"}


@pytest.mark.parametrize(
    "change",
    [{"mean": (1.0,)}, {"scale": (1.0,) * 4}, {"components": ()}, {"components": ((1.0, 2.0),)}, {"pca_mean": ()}],
)
def test_malformed_models_are_rejected(change):
    good = {f: getattr(DEFAULT_MODEL, f) for f in DEFAULT_MODEL.__dataclass_fields__}
    with pytest.raises(ValueError):
        PcaModel(**{**good, **change})


def test_missing_artifact_parts(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"meta": {"version": "v1"}}')
    with pytest.raises(ValueError):
        read_model(spark, str(tmp_path / "m.json"))


def test_plain_artifact_without_our_meta_fields(spark, tmp_path):
    write_model(spark, DEFAULT_MODEL, str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m")).first()[0]
    stripped = text.replace('"preprocessed":false,"log1p_network":false', '"note":"x"')
    assert stripped != text
    (tmp_path / "plain.json").write_text(stripped)
    assert read_model(spark, str(tmp_path / "plain.json")).threshold == DEFAULT_MODEL.threshold


def test_sweep_equals_separate_trainings(telemetry):
    df = rows(telemetry, [correlated(i) for i in range(120)])
    sweep = Sweep("grid", (1, 3), (90.0, 99.0))
    got = {(r["n_components"], r["percentile"]): r for r in run_sweep(df, sweep).collect()}
    for k, p in sweep.trials():
        assert got[k, p]["selection_metric_value"] == pytest.approx(train(df, k, p).threshold, abs=1e-9)
    best = [r for r in got.values() if r["is_best"]]
    assert len(best) == 1
    assert best[0]["selection_metric_value"] == min(r["selection_metric_value"] for r in got.values())
    with pytest.raises(ValueError):
        run_sweep(df, Sweep("grid", (9,)))


def test_training_narrows_large_groups(telemetry):
    df = rows(telemetry, [correlated(i) for i in range(200)])
    assert train(df, 2, 97.0, group_rows=20).threshold == pytest.approx(train(df, 2, 97.0).threshold, abs=1e-12)


def test_scores_of_a_preprocessing_model_keep_raw_features(telemetry):
    model = train(rows(telemetry, [correlated(i) for i in range(50)]), preprocessed=True, log1p_network=True)
    out = score(telemetry([reading(1, cpu=-5, rx=100)]), model).first()
    assert out["cpu_usage"] == -5.0 and out["network_rx_rate"] == 100.0
    fixed = [0.0, 10.0, 10.0, np.log1p(100.0), np.log1p(10.0)]
    assert out["reconstruction_error"] == pytest.approx(np.linalg.norm(reconstruct(fixed, model)), abs=1e-9)
