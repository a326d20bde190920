from __future__ import annotations

import datetime as dt

import pytest

from hostvane.functions import checks
from hostvane.functions.timerules import (
    auto_bucket_seconds,
    bucket_label,
    bucket_seconds,
    format_iso,
    parse_iso,
    previous_period,
)
from hostvane.operators.paging import has_more
from hostvane.operators.tuning import Sweep


@pytest.mark.parametrize(
    "end, seconds",
    [
        ("2026-02-01T06:00:00Z", 300),
        ("2026-02-03T00:00:00Z", 3600),
        ("2026-03-03T00:00:00Z", 21600),
        ("2026-07-31T00:00:00Z", 86400),
        ("2027-02-01T00:00:00Z", 604800),
    ],
)
def test_auto_bucket(end, seconds):
    assert auto_bucket_seconds("2026-02-01T00:00:00Z", end) == seconds


def test_bucket_names():
    assert bucket_seconds("15m") == 900
    assert bucket_seconds("weekly") == 3600
    assert bucket_seconds("auto", "bad", "worse") == 3600
    assert [bucket_label(s) for s in (300, 3600, 21600, 86400, 604800, 60)] == ["5m", "1h", "6h", "1d", "7d", "60s"]


def test_iso_times():
    assert parse_iso("2026-02-03T04:05:06Z") == dt.datetime(2026, 2, 3, 4, 5, 6)
    assert parse_iso("2026-02-03T04:05:06") == parse_iso("2026-02-03T04:05:06.789Z")
    assert [parse_iso(t) for t in ("", None, "yesterday", "2026-13-01T00:00:00", "2026-02-03")] == [None] * 5
    assert format_iso(dt.datetime(2026, 2, 3, 4, 5, 6)) == "2026-02-03T04:05:06Z"


def test_previous_period():
    now = ("2026-02-03T00:00:00Z", "2026-02-04T00:00:00Z")
    assert previous_period(*now) == ("2026-02-02T00:00:00Z", "2026-02-03T00:00:00Z")
    assert previous_period("", now[1]) is None
    assert previous_period(now[1], now[0]) is None


def test_has_more():
    cases = [(20, 0, 20, 100), (20, 40, 20, 100), (20, 80, 20, 100), (20, 0, 20, None), (20, 0, 10, None)]
    assert [has_more(*c) for c in cases] == [True, True, False, True, False]


@pytest.mark.parametrize("bad", ["", "CPU_USAGE", "cpu_usage; DROP TABLE x", "1=1", "cpu_usage--", "h.cpu_usage"])
def test_names_are_checked(bad):
    for check in (checks.metric, checks.dimension, checks.aggregation):
        with pytest.raises(ValueError):
            check(bad)


def test_names_pass():
    assert checks.metrics(["cpu_usage", "network_tx_rate"]) == ("cpu_usage", "network_tx_rate")
    assert checks.dimension("anomaly_type") == "anomaly_type"
    assert [checks.aggregation(a) for a in ("mean", "min", "max", "p50", "p95")]
    with pytest.raises(ValueError):
        checks.metrics([])


def test_grid_trials_in_order():
    sweep = Sweep("grid", (2, 3), (99.0, 99.5))
    assert sweep.trials() == [(2, 99.0), (2, 99.5), (3, 99.0), (3, 99.5)]
    assert len(Sweep("grid", (1, 2, 3, 4), (95.0, 99.0, 99.5)).trials()) == 12
    assert Sweep("grid", percentile=(99.0,)).trials() == [(3, 99.0)]
    assert Sweep("grid", n_components=(2,)).trials() == [(2, 99.5)]


def test_random_trials_repeat():
    sweep = Sweep("random", (2, 3, 4, 5), (90.0, 95.0, 99.0, 99.9), max_trials=5, seed=42)
    assert len(sweep.trials()) == 5
    assert sweep.trials() == sweep.trials()


def test_sweep_problems():
    fields = lambda s: [f for f, _ in s.problems()]
    assert fields(Sweep("grid", (2,), (99.0,))) == []
    assert fields(Sweep("bayes", (2,), (99.0,))) == ["algorithm"]
    assert fields(Sweep("grid", (2,), max_trials=0)) == ["max_trials"]
    assert fields(Sweep("grid", (2,), max_trials=51)) == ["max_trials"]
    assert fields(Sweep("grid", (2, 3), (99.0, 99.5), max_trials=3)) == ["search_space"]  # refused, never cut
    assert fields(Sweep("grid", (2, 3), (99.0, 99.5), max_trials=4)) == []
    assert fields(Sweep("grid")) == ["search_space"]
    assert fields(Sweep("grid", (6,))) == ["search_space.n_components"]
    assert fields(Sweep("grid", percentile=(100.0,))) == ["search_space.percentile"]
    assert fields(Sweep("grid", (1, 2, 3, 4, 5), tuple(90 + i / 10 for i in range(30)))) == ["search_space"]
