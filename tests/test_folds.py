"""Hosts cut into slices must give what one walk gives."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import by_record, counted, reading

from hostvane.functions.detectors import (
    AlertConfig,
    GateConfig,
    OutlierConfig,
    PipelineConfig,
    RobustZ,
    WindowConfig,
)
from hostvane.operators import detect, folds, rolling, sequences
from hostvane.operators.sequences import POSITION, SLICE, numbered, with_lead_in

VERDICT = ("a_flag", "a_score", "b_ran", "b_flag", "b_score", "details", "alert", "severity", "detector_source", "score")


def hosts(telemetry, lengths, seed=0, shift_at=None):
    draw = np.random.default_rng(seed)
    data, record = [], 0
    for h, n in enumerate(lengths):
        noise = np.round(draw.normal(0, 1, (n, 5)) + draw.binomial(1, 0.05, (n, 5)) * 40, 2)
        for i in range(n):
            level = 500.0 if shift_at is not None and i >= shift_at else 40.0
            cpu, mem, disk, rx, tx = level + noise[i]
            data.append(reading(record, seconds=i * 30, host=f"h{h}", cpu=cpu, mem=mem, disk=disk, rx=rx, tx=tx))
            record += 1
    order = draw.permutation(len(data))
    return telemetry([data[i] for i in order])


CONFIG = PipelineConfig(
    window=WindowConfig(20, 5, 8),
    outliers=OutlierConfig(3.0, True, 6.0),
    gate=GateConfig(True, 95_000),
    alerts=AlertConfig(2, 300),
)


def test_positions(telemetry):
    df = hosts(telemetry, [90, 3, 41])
    whole = by_record(numbered(df).rows, "host_id", POSITION)
    split = numbered(df, slice_rows=10)
    assert split.split and by_record(split.rows, "host_id", POSITION) == whole
    assert all(s == whole[r][1] // 10 for r, s in by_record(split.rows, SLICE).items())


def test_ties_are_broken_by_record(telemetry):
    df = telemetry([reading(r, seconds=0) for r in (5, 2, 9, 1)])
    assert by_record(numbered(df).rows, POSITION) == {1: 0, 2: 1, 5: 2, 9: 3}
    assert by_record(numbered(df, slice_rows=2).rows, POSITION) == {1: 0, 2: 1, 5: 2, 9: 3}


def test_lead_in_needs_room(telemetry):
    seq = numbered(hosts(telemetry, [30]), slice_rows=10)
    with pytest.raises(ValueError):
        with_lead_in(seq, 11)
    rows = with_lead_in(seq, 4)
    assert counted(rows.where("_lead AND _slice < 3")) == 8 and counted(rows.where("NOT _lead")) == 30


@pytest.mark.parametrize("slice_rows", [1, 7, 50])
def test_pipeline_does_not_depend_on_slices(telemetry, slice_rows):
    df = hosts(telemetry, [120, 5, 60] if slice_rows > 1 else [12, 1, 5])
    whole = by_record(detect.fused_pipeline(df, CONFIG), *VERDICT)
    cut = by_record(detect.fused_pipeline(df, CONFIG, slice_rows=slice_rows), *VERDICT)
    assert cut == whole
    if slice_rows > 1:
        assert any(v[0] for v in whole.values()) and any(v[6] for v in whole.values())


def test_locked_detector_is_carried_through_slices(telemetry):
    """After a jump every reading is refused, so the old history must reach the last slice."""
    df = hosts(telemetry, [150], shift_at=60)
    cfg = OutlierConfig(3.0, True, 6.0)
    whole = by_record(detect.poison_aware_z(df, CONFIG.window, cfg), "a_flag", "a_score", "details")
    cut = by_record(detect.poison_aware_z(df, CONFIG.window, cfg, slice_rows=10), "a_flag", "a_score", "details")
    assert cut == whole
    assert all(whole[r][0] and "(skipped)" in whole[r][2] for r in range(60, 150))


def test_gate_without_flags_is_carried_through_slices(telemetry):
    """No flag ever resynchronizes the schedule, so its phase must be carried too."""
    flat = telemetry([reading(i, seconds=i * 30) for i in range(100)])
    verdicts = flat.selectExpr(
        *detect.IDENTITY, "false AS a_flag", "0.5D AS reconstruction_error", "false AS predicted_is_anomaly"
    )
    whole = by_record(detect.gated_model(verdicts, GateConfig(True, 200_000)), "b_ran")
    assert by_record(detect.gated_model(verdicts, GateConfig(True, 200_000), slice_rows=9), "b_ran") == whole
    assert [r for r in sorted(whole) if whole[r]] == list(range(0, 100, 7))
    assert all(by_record(detect.gated_model(verdicts, GateConfig(False)), "b_ran").values())


@pytest.mark.parametrize("fan", [2, 3])
def test_summaries_as_a_tree_give_the_same(telemetry, monkeypatch, fan):
    """Many slices, composed a few at a time over several levels."""
    monkeypatch.setattr(folds, "FAN", fan)
    df = hosts(telemetry, [150, 5, 40])
    whole = by_record(detect.fused_pipeline(df, CONFIG), *VERDICT)
    assert by_record(detect.fused_pipeline(df, CONFIG, slice_rows=5), *VERDICT) == whole


@pytest.mark.parametrize("slice_rows", [1_000_000, 6])
def test_alerts_need_adjacent_flags(telemetry, slice_rows):
    df = telemetry([reading(i, seconds=i) for i in range(30)])
    flags = "record_id IN (2, 3, 7, 9, 10, 11, 25, 26, 27)"
    verdicts = df.selectExpr(
        *detect.IDENTITY, f"{flags} AS a_flag", "5.0D AS a_score", "false AS b_flag", "0.0D AS b_score"
    )
    alerts = detect.raise_alerts(verdicts, AlertConfig(2, 10), slice_rows=slice_rows)
    assert sorted(by_record(alerts, "severity")) == [3, 26]
    # without cooldown every second flag of a run of flags fires
    eager = detect.raise_alerts(verdicts, AlertConfig(2, 0), slice_rows=slice_rows)
    assert sorted(by_record(eager, "severity")) == [3, 10, 26]


def test_runs_do_not_share_state(telemetry):
    one = [reading(i, seconds=i, run="a") for i in range(2)]
    two = [reading(10 + i, seconds=i, run="b") for i in range(2)]
    verdicts = telemetry(one + two).selectExpr(
        *detect.IDENTITY, "true AS a_flag", "5.0D AS a_score", "false AS b_flag", "0.0D AS b_score"
    )
    assert sorted(by_record(detect.raise_alerts(verdicts, AlertConfig(2, 10)), "severity")) == [1, 11]


@pytest.mark.parametrize("window", [WindowConfig(20, 5, 8), WindowConfig(7, 3, 4), WindowConfig(4, 6, 5), WindowConfig(9, 1, 1)])
@pytest.mark.parametrize("slice_rows", [1_000_000, 30])
def test_window_form_equals_step_form(telemetry, window, slice_rows):
    df = hosts(telemetry, [100, 30], seed=3)
    limits = OutlierConfig(3.0)
    stepped = by_record(detect.poison_aware_z(df, window, limits), "a_flag", "a_score", "details")
    windowed = by_record(rolling.robust_z(df, window, limits, slice_rows=slice_rows), "is_flagged", "max_z", "details")
    for record, (flag, z, details) in stepped.items():
        assert windowed[record] == (flag, pytest.approx(z, rel=1e-12), details or "")


def test_rolling_stats(telemetry):
    df = hosts(telemetry, [50])
    cpu = {r["record_id"]: r["cpu_usage"] for r in df.collect()}
    for slice_rows in (1_000_000, 10):
        got = by_record(rolling.rolling_stats(df, ["cpu_usage"], 8, slice_rows), "cpu_usage_mean", "cpu_usage_std")
        for i in range(50):
            recent = [cpu[j] for j in range(max(0, i - 7), i + 1)]
            assert got[i] == (pytest.approx(np.mean(recent)), pytest.approx(np.std(recent), abs=1e-6))


def test_fused_details(telemetry):
    quiet = [reading(i, seconds=i, cpu=40 + i % 3, mem=32 + i % 2, disk=30 + i % 3, rx=50 + i % 4, tx=25 + i % 2) for i in range(40)]
    spike = reading(40, seconds=40, cpu=95, mem=32, disk=30, rx=50, tx=25)
    cfg = PipelineConfig(outliers=OutlierConfig(3.0, True), gate=GateConfig(True, 10_000), alerts=AlertConfig(1, 0))
    out = by_record(detect.fused_pipeline(telemetry([*quiet, spike]), cfg), "severity", "details", "b_ran")
    severity, details, ran = out[40]
    assert severity == "CRITICAL" and ran
    assert details.startswith("[A:cpu_usage:rz=") and "(skipped)" in details
    assert "[B:PCA_RECON_ERR=" in details and "SKIPPED" not in details


def test_states_of_many_hosts_in_one_batch():
    detector = RobustZ(WindowConfig(5, 2, 3), OutlierConfig())
    values = np.arange(40, dtype=float).reshape(8, 5)
    z, _, after = detector.advance(values, np.array([0, 6]), np.array([6, 8]), np.array([0, 0]), [detector.initial()] * 2)
    alone = detector.advance(values[6:], np.array([0]), np.array([2]), np.array([0]), [detector.initial()])
    np.testing.assert_array_equal(z[6:], alone[0])
    np.testing.assert_array_equal(after[1][0], alone[2][0][0])


def test_short_slices_are_numbered_in_few_ranges(spark, monkeypatch):
    seen = []
    by_ranges = sequences.number_by_ranges
    monkeypatch.setattr(sequences, "number_by_ranges", lambda df, keys, order, n: seen.append(n) or by_ranges(df, keys, order, n))
    rows = spark.range(200).selectExpr("'r' AS run_id", "concat('h', id % 2) AS host_id", "id AS metric_timestamp", "id AS record_id")
    seq = sequences.numbered(rows, slice_rows=2)
    assert seq.split and seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    got = {r["record_id"]: (r[sequences.POSITION], r[sequences.SLICE]) for r in seq.rows.collect()}
    assert got == {k: (k // 2, k // 4) for k in range(200)}
