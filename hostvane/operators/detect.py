"""Detectors whose verdicts depend on earlier verdicts, and the fused pipeline."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvane.functions.detectors import (
    NOT_RUN,
    AlertConfig,
    AlertState,
    AlertSummary,
    GateConfig,
    GateSummary,
    OutlierConfig,
    PipelineConfig,
    RobustZ,
    WindowConfig,
    alert_rows,
    gate,
    severity,
    summarize_alerts,
    summarize_gate,
    z_details,
)
from hostvane.functions.features import preprocess
from hostvane.functions.pca import score
from hostvane.operators.folds import run_fold
from hostvane.operators.sequences import POSITION, SLICE, SLICE_ROWS, HostRows, for_hosts
from hostvane.schemas import FEATURES, HOST_KEYS, TIME_ORDER
from hostvane.session import materialize

MICROS = "time_us"
ERROR, MODEL_FLAG = "reconstruction_error", "predicted_is_anomaly"

STATS_FIELDS = [("a_flag", T.BooleanType()), ("a_score", T.DoubleType())]
B_TEXT = ("b_details", T.StringType())  # set for rows that raise an alert
MODEL_FIELDS = [("b_ran", T.BooleanType()), ("b_flag", T.BooleanType()), ("b_score", T.DoubleType())]
ALERT_FIELDS = [
    ("alert", T.BooleanType()),
    ("severity", T.StringType()),
    ("detector_source", T.StringType()),
    ("score", T.DoubleType()),
]


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


def epoch_micros(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column))


class PoisonFold:
    """Robust z where readings far out are flagged but kept out of the history."""

    columns = FEATURES
    result = _fields(*STATS_FIELDS, ("details", T.StringType()))

    def __init__(self, window: WindowConfig, outliers: OutlierConfig):
        self.detector = RobustZ(window, outliers)

    def initial(self):
        return self.detector.initial()

    def judge(self, rows, starts, ends, states):
        values = np.column_stack([rows[f] for f in FEATURES])
        positions = rows[POSITION][starts]
        z, skipped, after = self.detector.advance(values, starts, ends, positions, states)
        above = z > self.detector.outliers.robust_z_threshold
        return z, above, skipped, after

    def run(self, rows, starts, ends, states):
        z, above, skipped, after = self.judge(rows, starts, ends, states)
        flag = above.any(axis=1)
        details = np.full(len(flag), None, dtype=object)
        details[flag] = z_details(z[flag], above[flag], skipped[flag])
        return {"a_flag": flag, "a_score": largest_flagged(z, above), "details": details}, after


def largest_flagged(z, above):
    return np.where(above, z, 0.0).max(axis=1)


def model_texts(which, rows, threshold: float):
    """What the model found in the rows ``which``: numbers to six significant digits."""
    texts = np.full(len(rows["b_flag"]), None, dtype=object)
    for i in which:
        found = f"[B:PCA_RECON_ERR={rows['b_score'][i]:.6g} > {threshold:g}] " if rows["b_flag"][i] else ""
        texts[i] = found + ("" if rows["b_ran"][i] else "[B:SKIPPED] ")
    return texts


class GateFold:
    """Run the model on flagged rows, and at least once per period."""

    columns = (MICROS, "a_flag", ERROR, MODEL_FLAG)
    result = _fields(*MODEL_FIELDS)
    matters = "true"

    def __init__(self, cfg: GateConfig):
        self.cfg = cfg

    def initial(self):
        return None

    def run(self, rows, starts, ends, states):
        ran = np.ones(len(rows[MICROS]), dtype=bool)
        after = list(states)
        if self.cfg.enabled:
            times, flags = rows[MICROS], rows["a_flag"]
            for i, (a, b) in enumerate(zip(starts, ends)):
                ran[a:b], after[i] = gate(times[a:b].tolist(), flags[a:b], states[i], self.cfg.period_ms)
        flag = rows[MODEL_FLAG] & ran
        shown = np.where(flag, rows[ERROR], 0.0)
        return {"b_ran": ran, "b_flag": flag, "b_score": np.where(ran, shown, NOT_RUN)}, after

    def summarize(self, rows):
        return json.dumps(vars(summarize_gate(rows[MICROS], rows["a_flag"], self.cfg.period_ms)))

    def follow(self, state, summary):
        return GateSummary(**json.loads(summary)).after(state, self.cfg.period_ms)

    def compose(self, first, then):
        return json.dumps(vars(GateSummary(**json.loads(first)).then(GateSummary(**json.loads(then)), self.cfg.period_ms)))


class AlertFold:
    """Hysteresis and cooldown over flagged rows. Unflagged rows need not be given."""

    matters = "a_flag OR b_flag"

    columns = (MICROS, "a_flag", "a_score", "b_flag", "b_score")
    result = _fields(*ALERT_FIELDS)

    def __init__(self, cfg: AlertConfig, threshold: float | None = None):
        """With the model's ``threshold``, and ``b_ran`` among the rows, alerts also say what the model found."""
        self.cfg, self.threshold = cfg, threshold
        if threshold is not None:
            self.columns, self.result = (*self.columns, "b_ran"), _fields(B_TEXT, *ALERT_FIELDS)

    def initial(self):
        return AlertState()

    def run(self, rows, starts, ends, states):
        positions, times = rows[POSITION], rows[MICROS]
        flagged = rows["a_flag"] | rows["b_flag"]
        n = len(flagged)
        alert = np.zeros(n, dtype=bool)
        level, source = np.full(n, None, dtype=object), np.full(n, None, dtype=object)
        points = np.full(n, np.nan)
        after = list(states)
        for s, (a, b) in enumerate(zip(starts, ends)):
            mine = a + np.flatnonzero(flagged[a:b])
            fired, after[s] = alert_rows(positions[mine], times[mine], states[s], self.cfg)
            alert[mine[fired]] = True
        for i in np.flatnonzero(alert):
            findings = (rows[c][i] for c in ("a_flag", "a_score", "b_flag", "b_score"))
            level[i], source[i], points[i] = severity(*findings)
        found = {"alert": alert, "severity": level, "detector_source": source, "score": points}
        if self.threshold is not None:
            found["b_details"] = model_texts(np.flatnonzero(alert), rows, self.threshold)
        return found, after

    def summarize(self, rows):
        return json.dumps(vars(summarize_alerts(rows[POSITION], rows[MICROS], self.cfg)))

    def follow(self, state, summary):
        return AlertSummary(**json.loads(summary)).after(state, self.cfg.cooldown_seconds * 1_000_000)

    def compose(self, first, then):
        cooldown = self.cfg.cooldown_seconds * 1_000_000
        return json.dumps(vars(AlertSummary(**json.loads(first)).then(AlertSummary(**json.loads(then)), cooldown)))


class FusedFold:
    """Statistics, gated model and alerts in one walk over a host's rows. ``a_details`` is set for rows that raise an alert."""

    columns = (*FEATURES, MICROS, ERROR, MODEL_FLAG)
    result = _fields(*STATS_FIELDS, *MODEL_FIELDS, ("a_details", T.StringType()), B_TEXT, *ALERT_FIELDS)

    def __init__(self, cfg: PipelineConfig):
        self.stats = PoisonFold(cfg.window, cfg.outliers)
        self.gate = GateFold(cfg.gate)
        self.alerts = AlertFold(cfg.alerts, cfg.model.threshold)

    def initial(self):
        return (self.stats.initial(), self.gate.initial(), self.alerts.initial())

    def run(self, rows, starts, ends, states):
        z, above, skipped, s0 = self.stats.judge(rows, starts, ends, [s[0] for s in states])
        stats = {"a_flag": above.any(axis=1), "a_score": largest_flagged(z, above)}
        model, s1 = self.gate.run({**rows, **stats}, starts, ends, [s[1] for s in states])
        alerts, s2 = self.alerts.run({**rows, **stats, **model}, starts, ends, [s[2] for s in states])
        details = np.full(len(z), None, dtype=object)
        fired = np.flatnonzero(alerts["alert"])
        details[fired] = z_details(z[fired], above[fired], skipped[fired])
        return {**stats, **model, "a_details": details, **alerts}, list(zip(s0, s1, s2))


FUSED_COLUMNS = tuple("details" if f.name == "a_details" else f.name for f in FusedFold.result if f.name != B_TEXT[0])


def with_details(verdicts: DataFrame) -> DataFrame:
    """What each alert says: both detectors' findings, and whether the model was skipped."""
    stats = F.when(F.col("a_details") != "", F.concat(F.lit("[A:"), "a_details", F.lit("] "))).otherwise("")
    return verdicts.withColumn("details", F.when(F.col("alert"), F.concat(stats, B_TEXT[0])))


IDENTITY = (*HOST_KEYS, *TIME_ORDER)


def poison_aware_z(
    telemetry: DataFrame,
    window: WindowConfig = WindowConfig(),
    outliers: OutlierConfig = OutlierConfig(mitigate_poison=True),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    fold = PoisonFold(window, outliers)
    return for_hosts(telemetry.select(*IDENTITY, *FEATURES), lambda seq: run_fold(seq, fold, IDENTITY), slice_rows)


def gated_model(
    verdicts: DataFrame, cfg: GateConfig = GateConfig(enabled=True), slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``verdicts``: one row per reading with ``a_flag``, the model's error and its flag."""
    rows = verdicts.select(*IDENTITY, "a_flag", ERROR, MODEL_FLAG, epoch_micros(verdicts, TIME_ORDER[0]).alias(MICROS))
    return for_hosts(rows, lambda seq: run_fold(seq, GateFold(cfg), (*IDENTITY, "a_flag")), slice_rows, verdicts)


def raise_alerts(
    verdicts: DataFrame, cfg: AlertConfig = AlertConfig(), carry: Sequence[str] = (), slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Alerts from rows with ``a_flag``, ``a_score``, ``b_flag`` and ``b_score``.

    Rows are numbered first; then only flagged rows travel to the fold, which sees an unflagged
    row as a gap in the numbers.
    """
    rows = verdicts.select(
        *IDENTITY, "a_flag", "a_score", "b_flag", "b_score", *carry, epoch_micros(verdicts, TIME_ORDER[0]).alias(MICROS)
    )

    def flagged_only(seq: HostRows) -> DataFrame:
        flagged = replace(seq, rows=seq.rows.where(F.col("a_flag") | F.col("b_flag")))
        return run_fold(flagged, AlertFold(cfg), (*IDENTITY, *carry))

    return alerts_only(for_hosts(rows, flagged_only, slice_rows, verdicts), *carry)


def alerts_only(verdicts: DataFrame, *carry: str) -> DataFrame:
    time = F.col(TIME_ORDER[0]).alias("timestamp")
    return verdicts.where("alert").select(
        "host_id", "run_id", time, "record_id", "severity", "detector_source", "score", *carry
    )


def fused_input(telemetry: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Features as the detectors see them, and the model's verdict, all in generated code."""
    rows = telemetry.select(*IDENTITY, *FEATURES, epoch_micros(telemetry, TIME_ORDER[0]).alias(MICROS))
    return score(preprocess(rows, cfg.log1p_network), cfg.model)


def fused_pipeline(
    telemetry: DataFrame, cfg: PipelineConfig = PipelineConfig(), slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Every row with both detectors' verdicts and whether it raises an alert.

    One walk per host does everything. For hosts too large for one task the three steps run one after
    the other instead, each over slices of hosts.
    """

    def build(seq: HostRows) -> DataFrame:
        verdicts = _staged(seq, cfg) if seq.split else run_fold(seq, FusedFold(cfg), IDENTITY)
        return with_details(verdicts).select(*IDENTITY, *FUSED_COLUMNS)

    return for_hosts(fused_input(telemetry, cfg), build, slice_rows, telemetry)


def _staged(seq: HostRows, cfg: PipelineConfig) -> DataFrame:
    def staged(rows: DataFrame) -> HostRows:
        return replace(seq, rows=materialize(rows, "stage"))

    base = (*IDENTITY, POSITION, SLICE, MICROS)
    stats = run_fold(seq, PoisonFold(cfg.window, cfg.outliers), (*base, ERROR, MODEL_FLAG))
    judged = staged(stats.withColumnRenamed("details", "a_details"))
    a_columns = ("a_flag", "a_score", "a_details")
    gated = staged(run_fold(judged, GateFold(cfg.gate), (*base, *a_columns)))
    b_columns = tuple(n for n, _ in MODEL_FIELDS)
    return run_fold(gated, AlertFold(cfg.alerts, cfg.model.threshold), (*IDENTITY, *a_columns, *b_columns))
