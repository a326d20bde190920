"""Streams in several micro-batches against the batch operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import START, by_record, counted, reading

from hostvane.functions.detectors import AlertConfig, GateConfig, OutlierConfig, PipelineConfig, WindowConfig
from hostvane.functions.pca import DEFAULT_MODEL, dataset_scores
from hostvane.operators import analytics, detect
from hostvane.schemas import FEATURES
from hostvane.streaming import fused, jobs

CONFIG = PipelineConfig(
    window=WindowConfig(20, 5, 8),
    outliers=OutlierConfig(3.0, True, 6.0),
    gate=GateConfig(True, 60_000),
    alerts=AlertConfig(2, 120),
)
VERDICT = ("a_flag", "a_score", "b_ran", "b_flag", "b_score", "details", "alert", "severity", "score")


def noisy(count, hosts=2, first=0):
    draw = np.random.default_rng(11)
    out = []
    for i in range(first, first + count):
        for h in range(hosts):
            cpu, mem, disk, rx, tx = 40 + draw.normal(0, 1, 5) + draw.binomial(1, 0.1, 5) * 30
            out.append(reading(i * hosts + h, seconds=i * 10, host=f"h{h}", cpu=cpu, mem=mem, disk=disk, rx=rx, tx=tx))
    return out


class Feed:
    """Files that arrive one after the other, each read by its own run of the stream."""

    def __init__(self, spark, telemetry, folder):
        self.session, self.telemetry, self.folder, self.parts = jobs.stream_session(spark), telemetry, folder, 0
        self.spark = spark

    def add(self, rows):
        part = self.telemetry(rows).coalesce(1)
        self.kind = part.schema["ingestion_time"].dataType
        part.write.mode("append").parquet(str(self.folder / "in"))

    def stream(self):
        return jobs.read_telemetry_stream(self.session, str(self.folder / "in"), 1, self.kind)

    def table(self, build, name="out"):
        made = build(self.stream())
        path = str(self.folder / name)
        jobs.finish(jobs.to_table(made, path, str(self.folder / f"{name}-log")))
        return self.spark.read.schema(made.schema).parquet(path)


@pytest.fixture
def feed(spark, telemetry, tmp_path):
    return Feed(spark, telemetry, tmp_path)


END = 10**6


def test_fused_stream_equals_batch_with_rows_out_of_order(feed, telemetry):
    rows = noisy(60)
    shuffled = [rows[i] for i in np.random.default_rng(2).permutation(len(rows))]
    build = lambda s: fused.stream_fused(s, CONFIG, delay="1 hour")
    feed.add(shuffled[:50])
    feed.table(build)
    feed.add(shuffled[50:])
    feed.table(build)
    # a much later row moves the watermark past everything before it
    feed.add([reading(END, seconds=END, host="late")])
    out = feed.table(build)
    want = by_record(detect.fused_pipeline(telemetry(rows), CONFIG), *VERDICT)
    assert by_record(out, *VERDICT) == want
    assert any(v[6] for v in want.values())


class Held:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.now = 0, -1
        self.values: dict[str, dict] = {}
        self.timers: set[int] = set()

    def getValueState(self, name, *schemas):
        return HeldState(self, self.values.setdefault(name, {}))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


class HeldState:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def _call(self):
        self.store.calls += 1
        return self.held

    def exists(self):
        return bool(self._call())

    def get(self):
        return self._call()[()]

    def update(self, value):
        self._call()[()] = value

    def clear(self):
        self._call().clear()

    def getValue(self, key):
        return self._call()[key]

    def updateValue(self, key, value):
        self._call()[key] = value

    def removeKey(self, key):
        del self._call()[key]

    def keys(self):
        return iter(list(self._call()))


def host_frame(times, first=0):
    draw = np.random.default_rng(3)
    n = len(times)
    metrics = {f: 40 + draw.normal(0, 1, n) + draw.binomial(1, 0.1, n) * 30 for f in FEATURES}
    return pd.DataFrame(
        {"record_id": np.arange(first, first + n), fused.MICROS: np.array(times, dtype="int64") * 1_000_000, **metrics,
         fused.ERROR: draw.random(n), fused.MODEL_FLAG: draw.random(n) < 0.2}
    )


def run_host(batches, watermarks, idle_ms=None):
    """(frames that came out, the store): timers fire as in Spark, once the batch's rows are in."""
    store, out = Held(), []
    processor = fused.FusedProcessor(CONFIG, idle_ms)
    processor.init(store)
    for rows, store_now in zip(batches, watermarks):
        store.now = store_now
        if rows is not None:
            list(processor.handleInputRows(("r", "h"), iter([rows]), store))
        for at in sorted(t for t in store.timers if t <= store.now):
            store.timers.discard(at)
            out.extend(processor.handleExpiredTimer(("r", "h"), store, None))
    return pd.concat(out, ignore_index=True), store


def test_state_calls_grow_with_chunks_not_with_minutes():
    rows = host_frame(range(0, 60 * 400, 60))
    out, store = run_host([rows, None], [-1, 10**12])
    assert out["record_id"].tolist() == list(range(400))
    assert store.calls < 20 and not store.values["rows"]


@pytest.mark.parametrize("release", [5, 10**6])
def test_overlapping_chunks_come_out_in_time_order(monkeypatch, release):
    rows = host_frame(np.sort(np.random.default_rng(4).integers(0, 900, 300)))
    whole, _ = run_host([rows, None], [-1, 10**12])
    monkeypatch.setattr(fused, "CHUNK_ROWS", 7)
    monkeypatch.setattr(fused, "RELEASE_ROWS", release)
    mixed = rows.sample(frac=1, random_state=1)
    parts = [mixed.iloc[:150], mixed.iloc[150:], None, None, None]
    out, store = run_host(parts, [-1, -1, 100_000, 500_500, 10**12], idle_ms=60_000)
    pd.testing.assert_frame_equal(out, whole)
    assert not store.values["rows"] and not store.values["host"]


def test_late_rows_are_dropped(feed, telemetry):
    rows = noisy(40, hosts=1)
    build = lambda s: fused.stream_fused(s, CONFIG, delay="0 seconds")
    feed.add(rows[:20])
    feed.table(build)
    feed.add([reading(900, seconds=5, host="h0"), *rows[20:]])
    feed.table(build)
    feed.add([reading(END, seconds=END, host="other")])
    out = by_record(feed.table(build), *VERDICT)
    assert 900 not in out and out.pop(END)
    assert out == by_record(detect.fused_pipeline(telemetry(rows), CONFIG), *VERDICT)


def test_idle_hosts_are_forgotten(feed, telemetry):
    build = lambda s: fused.stream_fused(s, CONFIG, delay="0 seconds", idle_ms=600_000)
    before, after = noisy(30, hosts=1), [reading(500 + i, seconds=50_000 + i * 10, host="h0", cpu=900) for i in range(6)]
    feed.add(before)
    feed.table(build)
    feed.add([reading(400, seconds=40_000, host="other")])
    feed.table(build)
    feed.add(after)
    feed.table(build)
    feed.add([reading(END, seconds=END, host="other")])
    out = by_record(feed.table(build), "a_flag")
    # with its history the host would flag these at once; forgotten, it warms up again
    assert not any(out[500 + i] for i in range(6))
    remembered = by_record(detect.fused_pipeline(telemetry(before + after), CONFIG), "a_flag")
    assert all(remembered[500 + i] for i in range(6))


def test_alerts_of_two_settings_on_one_record_are_two(spark, tmp_path):
    kind = "host_id string, run_id string, timestamp timestamp, record_id long, severity string"
    for sink, severity, batch in (("7", "HIGH", 0), ("b", "MEDIUM", 0), ("b", "MEDIUM", 1)):
        row = spark.createDataFrame([("h", "r", START, 1, severity)], kind)
        row.write.parquet(f"{tmp_path}/a/sink={sink}/batch={batch}")
    got = jobs.read_alerts(spark, f"{tmp_path}/a", row.schema)
    assert got.columns == [*row.columns, "sink"]
    assert sorted((r["sink"], r["severity"]) for r in got.collect()) == [("7", "HIGH"), ("b", "MEDIUM")]


def test_sketches_do_not_grow_with_rows_and_keep_their_error(spark):
    sizes = {}
    for n in (30_000, 400_000):
        df = spark.range(n).selectExpr(f"CAST(pmod(xxhash64(id), {n}) AS DOUBLE) AS cpu_usage")
        values = np.sort(df.toPandas()["cpu_usage"].to_numpy())
        sketches, picks = jobs.sketch_columns(["cpu_usage"], ["p50", "p95"])
        held = df.agg(*sketches)
        sizes[n] = len(held.first()[0])
        got = held.select(*[c.alias(name) for name, c in picks.items()]).first()
        for name, p in (("cpu_usage_p50", 0.5), ("cpu_usage_p95", 0.95)):
            assert abs(np.searchsorted(values, got[name], side="right") / n - p) < 2 * 1.7 / jobs.KLL_K**0.9
    assert sizes[400_000] < 1.3 * sizes[30_000] < 100_000


def test_sketched_series_is_exact_in_small_buckets(feed, telemetry):
    rows = noisy(400)
    for part in (rows[:500], rows[500:], [reading(END, seconds=END, host="late")]):
        feed.add(part)
    got = feed.table(lambda t: jobs.stream_series(t, ["cpu_usage"], ["p50", "p95", "max"], 600, "1 hour", exact=False))
    seen = {(r["run_id"], r["ts"]): r for r in got.collect()}
    want = {}
    for r in rows:
        want.setdefault(r["metric_timestamp"].replace(minute=r["metric_timestamp"].minute // 10 * 10, second=0, microsecond=0), []).append(r["cpu_usage"])
    assert len(seen) == len(want)
    for (_, ts), r in seen.items():
        values = sorted(want[ts])
        assert r["count"] == len(values) and r["cpu_usage_max"] == values[-1]
        assert r["cpu_usage_p95"] == values[-(-95 * len(values) // 100) - 1] and r["cpu_usage_p50"] == values[-(-len(values) // 2) - 1]


def test_alerts_of_two_streams_and_of_other_cuts_count_once(feed, telemetry):
    rows = noisy(60)
    for part in (rows[:80], rows[80:], [reading(END, seconds=END, host="late")]):
        feed.add(part)
    path = str(feed.folder / "alerts")

    def run(log, sink, runs, files=1):
        stream = jobs.read_telemetry_stream(feed.session, str(feed.folder / "in"), files, feed.kind).where(runs)
        alerts = fused.stream_alerts(stream, CONFIG, delay="1 hour")
        jobs.finish(jobs.alerts_to_table(alerts, path, str(feed.folder / log), sink))
        return alerts.schema

    even, odd = "record_id % 2 = 0 OR record_id = 1000000", "record_id % 2 = 1 OR record_id = 1000000"
    run("log1", "even", even)
    schema = run("log2", "odd", odd)
    first = sorted(map(tuple, jobs.read_alerts(feed.spark, path, schema).collect()))
    run("log3", "even", even, files=2)  # a lost checkpoint, and other batches
    run("log4", "odd", odd, files=3)
    assert sorted(map(tuple, jobs.read_alerts(feed.spark, path, schema).collect())) == first
    want = []
    for part in (even, odd):
        batch = detect.fused_pipeline(telemetry(rows).where(part), CONFIG)
        want += [r["record_id"] for r in detect.alerts_only(batch).collect()]
    assert sorted(r[3] for r in first) == sorted(want) and want


def test_late_rows_are_counted_and_input_can_be_closed(feed, telemetry):
    rows = noisy(40, hosts=1)
    closing, path, log = str(feed.folder / "closing"), str(feed.folder / "out"), str(feed.folder / "log")
    late = []

    def run():
        stream = jobs.with_closing(feed.stream(), closing)
        out = fused.stream_fused(stream, CONFIG, delay="0 seconds")
        late.append(jobs.finish_counting(jobs.to_table(out, path, log)))
        return stream.schema, out.schema

    feed.add(rows[:20])
    run()
    feed.add([reading(900, seconds=5, host="h0"), reading(901, seconds=7, host="h0"), *rows[20:]])
    schema, made = run()
    jobs.close_input(feed.session, closing, schema)
    run()
    assert late == [0, 2, 0]
    out = by_record(feed.spark.read.schema(made).parquet(path), *VERDICT)
    assert out == by_record(detect.fused_pipeline(telemetry(rows), CONFIG), *VERDICT)


def test_a_timeout_is_raised(feed):
    feed.add(noisy(60))
    alerts = fused.stream_fused(feed.stream(), CONFIG)
    query = jobs.to_table(alerts, str(feed.folder / "o"), str(feed.folder / "l"))
    with pytest.raises(TimeoutError):
        jobs.finish(query, 0.001)


def test_series_stream(feed, telemetry):
    rows = noisy(400, hosts=1)
    feed.add(rows[:200])
    feed.add(rows[200:])
    out = feed.table(lambda s: jobs.stream_series(s, ["cpu_usage"], ["mean", "p95"], 600, "10 minutes"))
    batch = analytics.time_series(telemetry(rows), ["cpu_usage"], ["mean", "p95"], 600)
    newest = START + dt.timedelta(seconds=3990)
    closed = {r["ts"]: (r["count"], r["cpu_usage_mean"], r["cpu_usage_p95"]) for r in batch.collect()
              if r["ts"] + dt.timedelta(minutes=20) <= newest}
    got = {r["ts"].replace(tzinfo=None): (r["count"], r["cpu_usage_mean"], r["cpu_usage_p95"])
           for r in out.withColumn("ts", jobs.zoneless("ts")).collect()}
    assert got.keys() == closed.keys() and len(got) >= 5
    for ts, values in closed.items():
        assert got[ts] == pytest.approx(values)


def test_score_stream(feed, telemetry):
    rows = noisy(20)
    feed.add(rows)
    out = feed.table(lambda s: jobs.stream_scores(s, DEFAULT_MODEL, "m"))
    want = dataset_scores(telemetry(rows), DEFAULT_MODEL, "m")
    assert by_record(out, "reconstruction_error") == by_record(want, "reconstruction_error")
    # nothing new, nothing repeated
    assert counted(feed.table(lambda s: jobs.stream_scores(s, DEFAULT_MODEL, "m"))) == len(rows)
