"""Queries that run the detectors, checked by recursive SQL that walks each host row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostvane.functions.detectors import AlertConfig, GateConfig, OutlierConfig, PipelineConfig, WindowConfig
from hostvane.functions.pca import DEFAULT_MODEL, score
from hostvane.operators import detect, rolling
from hostvane.plans.dataset import T
from hostvane.plans.models import SCORED
from hostvane.plans.registry import query, rounded, with_ctes
from hostvane.plans.tables import telemetry
from hostvane.schemas import FEATURES
from hostvane.session import scratch_path
from hostvane.sources.results import append_alerts

# Every query below states the limits it runs with; the SQL is generated from the same values.
WINDOW = WindowConfig()
PLAIN = OutlierConfig()
GUARDED = OutlierConfig(robust_z_threshold=3.0, mitigate_poison=True)
GATE = GateConfig(enabled=True, period_ms=8 * 3600 * 1000)
ALERTS = AlertConfig(consecutive=2, cooldown_seconds=86_400)
PIPELINE = PipelineConfig(outliers=GUARDED, gate=GATE, alerts=ALERTS)

IN_ORDER = "PARTITION BY run_id, host_id ORDER BY metric_timestamp, record_id"
ID = "run_id, host_id, metric_timestamp, record_id"


@query(
    "rolling_stats",
    with_ctes(
        T,
        select=f"""
    SELECT {ID}, {', '.join(
        f'round(avg({m}) OVER w, 8) AS {m}_mean, round(stddev_pop({m}) OVER w, 8) AS {m}_std' for m in FEATURES)}
    FROM telemetry WINDOW w AS ({IN_ORDER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    ),
)
def rolling_stats(spark, sf_dir):
    # Means of 16 or 32 readings end in a 5 at the seventh decimal, so they are compared past it.
    return rounded(rolling.rolling_stats(telemetry(spark, sf_dir)), 8)


def robust_window_sql() -> tuple[str, ...]:
    """The window form: lists of the 60 rows before, looked at on every tenth row and held."""
    lists = ", ".join(f"list({m}) OVER before AS h_{m}" for m in FEATURES)
    medians = ", ".join(f"list_sort(h_{m})[len(h_{m}) // 2 + 1] AS m_{m}" for m in FEATURES)
    spreads = ", ".join(
        f"list_sort(list_transform(h_{m}, lambda x: abs(x - m_{m})))[len(h_{m}) // 2 + 1] AS d_{m}" for m in FEATURES
    )
    held = ", ".join(
        f"coalesce(last_value(CASE WHEN tick THEN {s}_{m} END IGNORE NULLS) OVER since, 0) AS {s}_{m}"
        for m in FEATURES
        for s in "md"
    )
    z = ", ".join(
        f"CASE WHEN pos >= 10 THEN abs({m} - m_{m}) / CASE WHEN d_{m} > 0 THEN d_{m} ELSE 1e-6 END ELSE 0 END AS z_{m}"
        for m in FEATURES
    )
    base = ", ".join([ID, *FEATURES])
    return (
        f"w0 AS (SELECT {base}, row_number() OVER ({IN_ORDER}) - 1 AS pos FROM telemetry)",
        f"""w1 AS (SELECT *, pos >= 10 AND pos % 10 = 0 AS tick, {lists} FROM w0
            WINDOW before AS (PARTITION BY run_id, host_id ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""",
        f"w2 AS (SELECT *, {medians} FROM w1)",
        f"w3 AS (SELECT *, {spreads} FROM w2)",
        f"""w4 AS (SELECT {base}, pos, {held} FROM w3
            WINDOW since AS (PARTITION BY run_id, host_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""",
        f"zs AS (SELECT *, {z} FROM w4)",
    )


Z_COLUMNS = ", ".join(f"round(z_{m}, 6) AS {m}_z" for m in FEATURES)


def flag_sql(limit: float) -> tuple[str, str, str]:
    """(is flagged, largest flagged z, details) over columns z_* and, if present, k_* for skipped."""
    flagged = " OR ".join(f"z_{m} > {limit}" for m in FEATURES)
    worst = "greatest(" + ", ".join(f"CASE WHEN z_{m} > {limit} THEN z_{m} ELSE 0 END" for m in FEATURES) + ")"
    details = " || ".join(
        f"CASE WHEN z_{m} > {limit} THEN '{m}:rz=' || format('{{:.1f}}', z_{m}) || k_{m} || ' ' ELSE '' END"
        for m in FEATURES
    )
    return f"({flagged})", worst, details


FLAGGED, WORST, DETAILS = flag_sql(PLAIN.robust_z_threshold)
NOTHING_SKIPPED = "zk AS (SELECT *, " + ", ".join(f"'' AS k_{m}" for m in FEATURES) + " FROM zs)"


@query("robust_z", with_ctes(T, *robust_window_sql(), select=f"SELECT {ID}, {Z_COLUMNS} FROM zs"))
def robust_z(spark, sf_dir):
    rows = rolling.robust_z(telemetry(spark, sf_dir), WINDOW, PLAIN)
    return rounded(rows.drop("is_flagged", "max_z", "details"))


@query(
    "robust_z_flags",
    with_ctes(
        T,
        *robust_window_sql(),
        NOTHING_SKIPPED,
        select=f"SELECT {ID}, round({WORST}, 6) AS max_z, {DETAILS} AS details FROM zk WHERE {FLAGGED}",
    ),
)
def robust_z_flags(spark, sf_dir):
    rows = rolling.robust_z(telemetry(spark, sf_dir), WINDOW, PLAIN)
    return rounded(rows.where("is_flagged").select("run_id", "host_id", "metric_timestamp", "record_id", "max_z", "details"))


def guarded_walk_sql() -> tuple[str, ...]:
    """Row by row per host: histories grow by accepted readings only."""
    per = lambda text: ", ".join(text.format(m=m) for m in FEATURES)
    carried = per("h_{m}, med_{m}, mad_{m}, z_{m}, k_{m}")
    limit = GUARDED.poison_threshold
    return (
        f"""numbered AS (SELECT {ID}, {', '.join(FEATURES)}, row_number() OVER ({IN_ORDER}) - 1 AS pos FROM telemetry)""",
        f"""walk AS (
      SELECT {ID}, pos, {per("[{m}] AS h_{m}, 0.0e0 AS med_{m}, 0.0e0 AS mad_{m}, 0.0e0 AS z_{m}, '' AS k_{m}")}
      FROM numbered WHERE pos = 0
      UNION ALL
      SELECT {ID}, pos, {per("CASE WHEN k_{m} = '' THEN list_append(h_{m}, {m})[-60:] ELSE h_{m} END, med_{m}, mad_{m}, z_{m}, k_{m}")}
      FROM (SELECT *, {per("CASE WHEN z_{m} > " + str(limit) + " THEN '(skipped)' ELSE '' END AS k_{m}")}
      FROM (SELECT *, {per('''CASE WHEN len(h_{m}) >= 10
              THEN abs({m} - med_{m}) / CASE WHEN mad_{m} > 0 THEN mad_{m} ELSE 1e-6 END ELSE 0 END AS z_{m}''')}
      FROM (SELECT * EXCLUDE ({per("old_{m}")}), {per('''CASE WHEN tick AND len(h_{m}) >= 10
              THEN CASE WHEN list_sort(list_transform(h_{m}, lambda x: abs(x - med_{m})))[len(h_{m}) // 2 + 1] = 0 THEN 1e-6
                   ELSE list_sort(list_transform(h_{m}, lambda x: abs(x - med_{m})))[len(h_{m}) // 2 + 1] END
              ELSE old_{m} END AS mad_{m}''')}
      FROM (SELECT n.*, n.pos % 10 = 0 AS tick, {per('''w.h_{m}, w.mad_{m} AS old_{m},
              CASE WHEN n.pos % 10 = 0 AND len(w.h_{m}) >= 10
              THEN list_sort(w.h_{m})[len(w.h_{m}) // 2 + 1] ELSE w.med_{m} END AS med_{m}''')}
      FROM walk w JOIN numbered n ON n.run_id = w.run_id AND n.host_id = w.host_id AND n.pos = w.pos + 1)))))""",
    )


G_FLAGGED, G_WORST, G_DETAILS = flag_sql(GUARDED.robust_z_threshold)


@query(
    "poison_aware_z",
    with_ctes(
        T,
        *guarded_walk_sql(),
        select=f"""
    SELECT {ID}, {G_FLAGGED} AS a_flag, round({G_WORST}, 6) AS a_score,
           CASE WHEN {G_FLAGGED} THEN {G_DETAILS} END AS details FROM walk""",
    ),
)
def poison_aware_z(spark, sf_dir):
    return rounded(detect.poison_aware_z(telemetry(spark, sf_dir), WINDOW, GUARDED))


def gate_walk_sql(source: str) -> str:
    """``gated``: walks ``source`` (identity, pos, us, a_flag) and marks the rows that run the model."""
    period = GATE.period_ms * 1000
    return f"""
    gate_walk AS (
      SELECT run_id, host_id, pos, record_id, true AS b_ran, us AS last_run FROM {source} WHERE pos = 0
      UNION ALL
      SELECT n.run_id, n.host_id, n.pos, n.record_id, n.a_flag OR n.us - g.last_run >= {period},
             CASE WHEN n.a_flag OR n.us - g.last_run >= {period} THEN n.us ELSE g.last_run END
      FROM gate_walk g JOIN {source} n ON n.run_id = g.run_id AND n.host_id = g.host_id AND n.pos = g.pos + 1)"""


def verdict_sql(flagged: str, score_sql: str, details: str, source: str) -> tuple[str, ...]:
    """``verdicts``: both detectors' results per row, the model gated."""
    return (
        f"""a_rows AS (
      SELECT {ID}, pos, epoch_us(metric_timestamp) AS us, {flagged} AS a_flag, {score_sql} AS a_score,
             {details} AS a_details FROM {source})""",
        gate_walk_sql("a_rows"),
        """verdicts AS (
      SELECT a_rows.*, b_ran, b_ran AND predicted_is_anomaly AS b_flag,
             CASE WHEN NOT b_ran THEN -1.0e0 WHEN predicted_is_anomaly THEN reconstruction_error ELSE 0.0e0 END AS b_score
      FROM a_rows JOIN gate_walk USING (record_id) JOIN scored USING (record_id))""",
    )


def alert_walk_sql(flagged: str) -> str:
    """``alerted``: consecutive count and time of the last alert, row by row."""
    cooldown = ALERTS.cooldown_seconds * 1_000_000
    fires = f"""CASE WHEN {flagged} AND cnt + 1 >= {ALERTS.consecutive}
               AND (last_alert IS NULL OR us - last_alert >= {cooldown}) THEN true ELSE false END"""
    return f"""
    alert_walk AS (
      SELECT run_id, host_id, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS record_id, false AS alert,
             0 AS cnt, CAST(NULL AS BIGINT) AS last_alert
      FROM verdicts WHERE pos = 0
      UNION ALL
      SELECT run_id, host_id, pos, record_id, alert,
             CASE WHEN alert OR NOT ({flagged}) THEN 0 ELSE cnt + 1 END,
             CASE WHEN alert THEN us ELSE last_alert END
      FROM (SELECT n.*, w.cnt, w.last_alert, {fires} AS alert
            FROM alert_walk w JOIN verdicts n ON n.run_id = w.run_id AND n.host_id = w.host_id AND n.pos = w.pos + 1))"""


SEVERITY = """CASE WHEN a_flag AND b_flag THEN 'CRITICAL' WHEN b_flag THEN 'HIGH' WHEN a_score > 10 THEN 'HIGH'
  ELSE 'MEDIUM' END"""
SOURCE = """CASE WHEN a_flag AND b_flag THEN 'FUSION_A_B' WHEN b_flag THEN 'DETECTOR_B_PCA' ELSE 'DETECTOR_A_STATS' END"""
ALERT_SCORE = "CASE WHEN a_flag AND b_flag THEN greatest(a_score, b_score) WHEN b_flag THEN b_score ELSE a_score END"

PLAIN_VERDICTS = (
    *robust_window_sql(),
    NOTHING_SKIPPED,
    SCORED,
    *verdict_sql(FLAGGED, f"CASE WHEN {FLAGGED} THEN {WORST} ELSE 0 END", "''", "zk"),
)


def plain_verdicts(spark, sf_dir):
    """Robust z without mitigation, joined with the model's verdict on the same record."""
    rows = telemetry(spark, sf_dir)
    stats = rolling.robust_z(rows, WINDOW, PLAIN).select(
        *detect.IDENTITY, F.col("is_flagged").alias("a_flag"), F.col("max_z").alias("a_score")
    )
    errors = score(rows, DEFAULT_MODEL).select("record_id", "reconstruction_error", "predicted_is_anomaly")
    return stats.join(errors, "record_id")


@query(
    "gated_scores",
    with_ctes(T, *PLAIN_VERDICTS, select=f"SELECT {ID}, a_flag, b_ran, b_flag, round(b_score, 6) AS b_score FROM verdicts"),
)
def gated_scores(spark, sf_dir):
    return rounded(detect.gated_model(plain_verdicts(spark, sf_dir), GATE))


ANY_FLAG = "(a_flag OR b_flag)"


@query(
    "alerts",
    with_ctes(
        T,
        *PLAIN_VERDICTS,
        alert_walk_sql(ANY_FLAG),
        select=f"""
    SELECT host_id, run_id, metric_timestamp AS timestamp, record_id, {SEVERITY} AS severity,
           {SOURCE} AS detector_source, round({ALERT_SCORE}, 6) AS score
    FROM verdicts JOIN alert_walk USING (record_id) WHERE alert""".replace("SELECT host_id, run_id", "SELECT verdicts.host_id, verdicts.run_id"),
    ),
)
def alerts(spark, sf_dir):
    """Alerts from verdicts that were computed one detector at a time."""
    verdicts = plain_verdicts(spark, sf_dir)
    gated = detect.gated_model(verdicts, GATE).join(verdicts.select("record_id", "a_score"), "record_id")
    return rounded(detect.raise_alerts(gated, ALERTS))


FUSED_VERDICTS = (
    *guarded_walk_sql(),
    SCORED,
    *verdict_sql(G_FLAGGED, f"CASE WHEN {G_FLAGGED} THEN {G_WORST} ELSE 0 END", G_DETAILS, "walk"),
    alert_walk_sql(ANY_FLAG),
)
FUSED_DETAILS = """CASE WHEN a_flag THEN '[A:' || a_details || '] ' ELSE '' END ||
  CASE WHEN b_flag THEN '[B:PCA_RECON_ERR=' || format('{:g}', b_score) || ' > 1.19713] ' ELSE '' END ||
  CASE WHEN NOT b_ran THEN '[B:SKIPPED] ' ELSE '' END"""


def fused_sql(columns: str, where: str = "true", source: str = T) -> str:
    return with_ctes(
        source,
        *FUSED_VERDICTS,
        "fused AS (SELECT verdicts.*, alert FROM verdicts JOIN alert_walk ON alert_walk.record_id = verdicts.record_id)",
        select=f"SELECT {columns} FROM fused WHERE {where}",
    )


@query(
    "fused_verdicts",
    fused_sql(f"""{ID}, a_flag, round(a_score, 6) AS a_score, b_ran, b_flag, round(b_score, 6) AS b_score,
        CASE WHEN alert THEN {FUSED_DETAILS} END AS details, alert, CASE WHEN alert THEN {SEVERITY} END AS severity,
        CASE WHEN alert THEN {SOURCE} END AS detector_source, round(CASE WHEN alert THEN {ALERT_SCORE} END, 6) AS score"""),
)
def fused_verdicts(spark, sf_dir):
    return rounded(detect.fused_pipeline(telemetry(spark, sf_dir), PIPELINE))


FUSED_ALERT = f"""host_id, run_id, metric_timestamp AS timestamp, record_id, {SEVERITY} AS severity,
    {SOURCE} AS detector_source, round({ALERT_SCORE}, 6) AS score, {FUSED_DETAILS} AS details"""


@query("fused_alerts", fused_sql(FUSED_ALERT, "alert"))
def fused_alerts(spark, sf_dir):
    fused = detect.fused_pipeline(telemetry(spark, sf_dir), PIPELINE)
    return rounded(detect.alerts_only(fused, "details"))


@query(
    "stored_alerts",
    with_ctes(
        T,
        *FUSED_VERDICTS,
        select=f"""
    SELECT run_id, {SEVERITY} AS severity, {SOURCE} AS detector_source, count(*) AS alerts
    FROM (SELECT verdicts.*, alert FROM verdicts JOIN alert_walk ON alert_walk.record_id = verdicts.record_id)
    WHERE alert GROUP BY 1, 2, 3""",
    ),
)
def stored_alerts(spark, sf_dir):
    """Alerts appended to their table and read back from it."""
    path = scratch_path(spark, "alerts")
    append_alerts(detect.alerts_only(detect.fused_pipeline(telemetry(spark, sf_dir), PIPELINE), "details"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("run_id", "severity", "detector_source").agg(F.count(F.lit(1)).alias("alerts"))


@query("fused_alerts_sliced", fused_sql(FUSED_ALERT, "alert"))
def fused_alerts_sliced(spark, sf_dir):
    """The same alerts with every host cut into slices, as a very large host would be."""
    fused = detect.fused_pipeline(telemetry(spark, sf_dir), PIPELINE, slice_rows=40)
    return rounded(detect.alerts_only(fused, "details"))


LARGE = 1e6
LARGE_T = T.replace("telemetry AS (", "usual AS (", 1) + f""",
telemetry AS (SELECT * REPLACE (network_rx_rate * {LARGE!r} AS network_rx_rate) FROM usual)"""
LARGE_ALERT = f"""host_id, run_id, metric_timestamp AS timestamp, record_id, {SEVERITY} AS severity,
    {SOURCE} AS detector_source, {FUSED_DETAILS} AS details"""


@query("fused_alerts_large", fused_sql(LARGE_ALERT, "alert", LARGE_T))
def fused_alerts_large(spark, sf_dir):
    """Errors of seven digits and more, from hosts cut into slices."""
    rows = telemetry(spark, sf_dir).withColumn("network_rx_rate", F.col("network_rx_rate") * LARGE)
    return detect.alerts_only(detect.fused_pipeline(rows, PIPELINE, slice_rows=40), "details").drop("score")
