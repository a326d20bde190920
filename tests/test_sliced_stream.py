"""Micro-batches with hosts cut into slices, against the batch operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import by_record, reading
from test_streaming import CONFIG, END, VERDICT, Feed, noisy

from hostvane.operators import detect
from hostvane.session import scratch_folder
from hostvane.sources import folders
from hostvane.streaming import fused, jobs, sliced


@pytest.fixture
def feed(spark, telemetry, tmp_path):
    return Feed(spark, telemetry, tmp_path)


def run(feed, name="s", delay_ms=0, **options):
    store = str(feed.folder / name)
    jobs.finish(sliced.stream_fused_sliced(feed.stream(), store, f"{store}-log", CONFIG, delay_ms, **options))
    return sliced.read_verdicts(feed.spark, store)


def test_slices_of_several_batches_equal_one_batch(feed, telemetry):
    """One host holds most rows and is cut into slices in every batch; rows come out of order within the delay."""
    rows = noisy(120, hosts=1) + [reading(5000 + i, seconds=i * 40, host="small", cpu=40 + i % 7) for i in range(30)]
    rows.sort(key=lambda r: r["metric_timestamp"])
    draw = np.random.default_rng(5)
    order = np.argsort([i + draw.uniform(0, 8) for i in range(len(rows))])
    rows = [rows[i] for i in order]
    for a, b in ((0, 60), (60, 150)):
        feed.add(rows[a:b])
    feed.add([reading(END, seconds=END, host="late")])
    got = run(feed, delay_ms=200_000, slice_rows=20)
    want = by_record(detect.fused_pipeline(telemetry(rows), CONFIG), *VERDICT)
    assert by_record(got, *VERDICT) == want and any(v[6] for v in want.values())
    assert sliced.late_rows(feed.spark, str(feed.folder / "s")) == 0
    assert not folders.folders(feed.spark, f"{scratch_folder(feed.spark)}/micro-batch-*")


def test_late_rows_idle_hosts_and_kept_folders(feed, telemetry, monkeypatch):
    monkeypatch.setattr(sliced, "COMPACT", 2)
    rows = noisy(60, hosts=1)
    for a in (0, 30):
        late = [reading(900, seconds=5, host="h0")] if a == 30 else []
        feed.add(rows[a : a + 30] + late)
    feed.add([reading(400, seconds=40_000, host="other")])
    after = [reading(500 + i, seconds=50_000 + i * 10, host="h0", cpu=900) for i in range(6)]
    feed.add(after)
    feed.add([reading(END, seconds=END, host="other")])
    out = by_record(run(feed, idle_ms=600_000), *VERDICT)
    store = str(feed.folder / "s")
    assert sliced.late_rows(feed.spark, store) == 1 and 900 not in out
    want = by_record(detect.fused_pipeline(telemetry(rows), CONFIG), *VERDICT)
    assert {k: v for k, v in out.items() if k in want} == want
    assert not any(out[500 + i][0] for i in range(6))  # forgotten, it warms up again
    assert len(folders.folders(feed.spark, f"{store}/arrived/batch=*")) == 2
    assert len(folders.folders(feed.spark, f"{store}/states/batch=*")) <= 4


def test_a_batch_that_broke_off_is_run_again(feed, telemetry, monkeypatch):
    rows = noisy(60, hosts=2)
    feed.add(rows[:60])
    run(feed)
    feed.add(rows[60:])
    broken = monkeypatch.context()
    with broken as m:
        m.setattr(sliced.folders, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run(feed)
    assert len(by_record(sliced.read_verdicts(feed.spark, str(feed.folder / "s")), "a_flag")) <= 60
    feed.add([reading(END, seconds=END, host="late")])
    got = by_record(run(feed), *VERDICT)
    got.pop(END, None)
    assert got == by_record(detect.fused_pipeline(telemetry(rows), CONFIG), *VERDICT)
    with pytest.raises(Exception, match="another checkpoint"):
        jobs.finish(sliced.stream_fused_sliced(feed.stream(), str(feed.folder / "s"), str(feed.folder / "log2"), CONFIG, 0))


class Kept(dict):
    """A map or value of the state store."""

    def containsKey(self, key):  # noqa: N802
        return key in self

    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = dict.__delitem__  # noqa: N815

    def exists(self):
        return bool(self)

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):  # noqa: N802
        return Kept()

    def getValueState(self, *_):  # noqa: N802
        return Kept()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Clock:
    ms = 0

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_timers_read_only_the_minutes_that_are_due(monkeypatch):
    names = list(fused.BUFFERED)
    made = fused.FusedProcessor(CONFIG, 10**12)
    handle, clock, read = Handle(), Clock(), []
    made.init(handle)
    real = fused.from_bytes
    monkeypatch.setattr(fused, "from_bytes", lambda chunks: read.append(len(chunks)) or real(chunks))
    for batch in range(40):  # a minute each, all still waiting
        rows = pd.DataFrame({n: [1.0] * 6 for n in names})
        rows["record_id"] = range(batch * 6, batch * 6 + 6)
        rows["time_us"] = [(batch * 60 + s * 10 + 1) * 1_000_000 for s in range(6)]
        rows[fused.MODEL_FLAG] = False
        assert not list(made.handleInputRows(("r", "h"), iter([rows]), clock))
    clock.ms = 125_000
    due = sorted(t for t in handle.timers if t <= clock.ms)
    out = pd.concat(frame for _ in due for frame in made.handleExpiredTimer(("r", "h"), clock, None))
    assert len(due) == 3 and read == [1, 1, 1]  # however many timers fire and rows wait
    assert out["record_id"].tolist() == list(range(13)) and len(made.rows) == 38
    clock.ms = 10**7
    rest = pd.concat(made.handleExpiredTimer(("r", "h"), clock, None))
    assert rest["record_id"].tolist() == list(range(13, 240)) and not made.rows and not made.chunks
