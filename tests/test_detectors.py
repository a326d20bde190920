"""Step functions against plain row-by-row walks."""

from __future__ import annotations

from collections import deque

from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostvane.functions.detectors import (
    AlertConfig,
    AlertState,
    OutlierConfig,
    RobustZ,
    WindowConfig,
    alert_rows,
    gate,
    pack,
    severity,
    summarize_alerts,
    summarize_gate,
    unpack,
    z_details,
)

SECOND = 1_000_000


def walk_z(values, window, outliers):
    """One host, one row at a time."""
    metrics = values.shape[1]
    history = [deque(maxlen=window.size) for _ in range(metrics)]
    median, mad = [0.0] * metrics, [0.0] * metrics
    z_all, skipped_all = np.zeros(values.shape), np.zeros(values.shape, dtype=bool)
    for t, row in enumerate(values):
        for i, x in enumerate(row):
            if len(history[i]) < window.min_history:
                history[i].append(x)
                continue
            if t % window.recompute_interval == 0:
                middle = len(history[i]) // 2
                median[i] = sorted(history[i])[middle]
                mad[i] = sorted(abs(v - median[i]) for v in history[i])[middle] or 1e-6
            z = abs(x - median[i]) / (mad[i] or 1e-6)
            skip = outliers.mitigate_poison and z > outliers.poison_threshold
            z_all[t, i], skipped_all[t, i] = z, skip
            if not skip:
                history[i].append(x)
    return z_all, skipped_all


def one_host(detector, values, cuts=()):
    """Run a host in pieces, carrying the state over through its packed form."""
    state = detector.initial()
    z, skipped = [], []
    bounds = [0, *cuts, len(values)]
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        piece = detector.advance(values[a:b], np.array([0]), np.array([b - a]), np.array([a]), [state])
        z.append(piece[0])
        skipped.append(piece[1])
        state = unpack(pack(piece[2][0]))
    return np.vstack(z), np.vstack(skipped)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_robust_z_equals_walk(data):
    window = WindowConfig(data.draw(st.integers(1, 12)), data.draw(st.integers(1, 6)), data.draw(st.integers(1, 9)))
    outliers = OutlierConfig(3.0, data.draw(st.booleans()), data.draw(st.sampled_from([1.0, 3.0, 7.0])))
    detector = RobustZ(window, outliers, metrics=2)
    draw = np.random.default_rng(data.draw(st.integers(0, 10_000)))
    hosts = [np.round(draw.lognormal(2, 1, (data.draw(st.integers(1, 50)), 2)), 1) for _ in range(3)]
    values = np.vstack(hosts)
    ends = np.cumsum([len(h) for h in hosts])
    starts = ends - [len(h) for h in hosts]
    z, skipped, _ = detector.advance(values, starts, ends, np.zeros(3, dtype=int), [detector.initial() for _ in hosts])
    for h, a, b in zip(hosts, starts, ends):
        want_z, want_skipped = walk_z(h, window, outliers)
        np.testing.assert_array_equal(z[a:b], want_z)
        np.testing.assert_array_equal(skipped[a:b], want_skipped)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(hosts[0])), max_size=3)))
    piecewise = one_host(detector, hosts[0], cuts)
    np.testing.assert_array_equal(piecewise[0], walk_z(hosts[0], window, outliers)[0])


def cpu_rows(cpu, others=10.0):
    values = np.full((len(cpu), 5), others)
    values[:, 0] = cpu
    return values


def test_spike_is_flagged_and_named():
    detector = RobustZ(WindowConfig(10, 2, 5), OutlierConfig(3.0))
    z, skipped = one_host(detector, cpu_rows([10.0] * 8 + [11.0, 9.0, 1000.0]))
    above = z > 3.0
    assert above[-1, 0] and z[-1].max() > 3.0
    assert "cpu_usage" in z_details(z[-1:], above[-1:], skipped[-1:])[0]


def test_poisoned_values_are_flagged_and_skipped():
    detector = RobustZ(WindowConfig(20, 1, 5), OutlierConfig(3.0, True, 5.0))
    values = cpu_rows([10.0 + i % 3 for i in range(30)] + [30.0] * 10 + [15.0])
    values[30:, 1:] = 10.0
    z, skipped = one_host(detector, values)
    above = z > 3.0
    details = z_details(z, above, skipped)
    assert above[30:, 0].all()
    assert all("(skipped)" in d for d in details[30:40])
    assert details[40] and "(skipped)" not in details[40]


def test_warm_but_not_yet_computed_flags_everything():
    """Pinned: with a warm-up that ends between recompute rows, the median is still 0."""
    z, _ = one_host(RobustZ(WindowConfig(60, 10, 5), OutlierConfig()), cpu_rows([10.0] * 12))
    assert (z[5:10] == 10.0 / 1e-6).all() and (z[10:] == 0.0).all()


def walk_gate(times, flags, last, period_ms):
    runs = []
    for t, f in zip(times, flags):
        run = f or last is None or (t - last) // 1000 >= period_ms
        runs.append(run)
        last = t if run else last
    return runs, last


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 9_000), st.booleans()), max_size=60),
    st.integers(1, 12),
    st.one_of(st.none(), st.integers(-5_000, 0)),
)
def test_gate_equals_walk(steps, period_ms, last):
    times = np.cumsum([s for s, _ in steps]).astype(int).tolist()
    flags = np.array([f for _, f in steps], dtype=bool)
    runs, after = gate(times, flags, last, period_ms)
    assert (runs.tolist(), after) == walk_gate(times, flags.tolist(), last, period_ms)


def fired_at(seconds, cfg, positions=None):
    positions = list(range(len(seconds))) if positions is None else positions
    fired, _ = alert_rows(positions, [int(s * SECOND) for s in seconds], AlertState(), cfg)
    return fired


def test_hysteresis_waits_for_second_flag():
    assert fired_at([0, 1], AlertConfig(2, 10)) == [1]


def test_cooldown():
    assert fired_at([0, 1, 6, 12, 13], AlertConfig(2, 10)) == [1, 3]


def test_gap_resets_count():
    assert fired_at([0, 2, 3], AlertConfig(2, 0), positions=[0, 2, 3]) == [2]


def test_count_keeps_rising_in_cooldown():
    # alert at 1; the flags at 2, 3 and 4 count although they are suppressed, so 11 fires at once
    assert fired_at([0, 1, 2, 3, 4, 11], AlertConfig(2, 10)) == [1, 5]
    # with three needed, only 4 and 11 follow the alert at 2 and the count is short at 11
    assert fired_at([0, 1, 2, 4, 12], AlertConfig(3, 10)) == [2]


@pytest.mark.parametrize(
    "a, a_score, b, b_score, want",
    [
        (True, 4.0, True, 0.5, ("CRITICAL", "FUSION_A_B", 4.0)),
        (False, 0.0, True, 0.1, ("HIGH", "DETECTOR_B_PCA", 0.1)),
        (True, 20.0, False, 0.0, ("HIGH", "DETECTOR_A_STATS", 20.0)),
        (True, 10.0, False, 0.0, ("MEDIUM", "DETECTOR_A_STATS", 10.0)),
    ],
)
def test_severity(a, a_score, b, b_score, want):
    assert severity(a, a_score, b, b_score) == want


def test_state_survives_packing():
    state = (RobustZ(WindowConfig(), OutlierConfig()).initial(), None, AlertState(3, 17, 4))
    again = unpack(pack(state))
    assert pack(again) == pack(state)
    assert again[2] == state[2] and again[1] is None
    np.testing.assert_array_equal(again[0][0], state[0][0])


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 9_000), st.booleans()), min_size=1, max_size=60),
    st.integers(1, 20),
    st.lists(st.integers(1, 59), max_size=4),
)
def test_gate_summaries_chain_to_the_walk(steps, period_ms, cuts):
    times = np.cumsum([s for s, _ in steps]).astype(int)
    flags = np.array([f for _, f in steps], dtype=bool)
    bounds = [0, *sorted({c for c in cuts if c < len(times)}), len(times)]
    state, walked, parts = None, None, []
    for a, b in zip(bounds, bounds[1:]):
        parts.append((state, summarize_gate(times[a:b], flags[a:b], period_ms)))
        state = parts[-1][1].after(state, period_ms)
        _, walked = gate(times[a:b].tolist(), flags[a:b], walked, period_ms)
        assert state == walked
    for k, (before, _) in enumerate(parts):  # composed from any slice on
        joint = reduce(lambda x, y: x.then(y, period_ms), [p for _, p in parts[k:]])
        assert joint.after(before, period_ms) == state


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 6), st.integers(1, 2)), min_size=1, max_size=60),
    st.integers(1, 5),
    st.integers(0, 15),
    st.lists(st.integers(1, 59), max_size=4),
)
def test_alert_summaries_chain_to_the_walk(steps, consecutive, cooldown, cuts):
    cfg = AlertConfig(consecutive, cooldown)
    times = np.cumsum([s for s, _ in steps]).astype(int) * SECOND
    positions = np.cumsum([p for _, p in steps]).astype(int)
    bounds = [0, *sorted({c for c in cuts if c < len(times)}), len(times)]
    state, walked, parts = AlertState(), AlertState(), []
    for a, b in zip(bounds, bounds[1:]):
        parts.append((state, summarize_alerts(positions[a:b], times[a:b], cfg)))
        state = parts[-1][1].after(state, cooldown * SECOND)
        _, walked = alert_rows(positions[a:b], times[a:b], walked, cfg)
        assert (state.last_alert, state.last_position) == (walked.last_alert, walked.last_position)
        assert state.count == walked.count
    for k in range(len(parts)):  # composed from any slice on, two by two in any grouping
        left = reduce(lambda x, y: x.then(y, cooldown * SECOND), [p for _, p in parts[k:]])
        right = reduce(lambda x, y: y.then(x, cooldown * SECOND), [p for _, p in parts[k:]][::-1])
        assert left.after(parts[k][0], cooldown * SECOND) == right.after(parts[k][0], cooldown * SECOND) == state
