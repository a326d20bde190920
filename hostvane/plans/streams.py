"""Streaming jobs run to the end of the events table, checked like batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.functions.pca import DEFAULT_MODEL
from hostvane.plans.dataset import T, bucket
from hostvane.plans.detection import FUSED_ALERT, PIPELINE, fused_sql
from hostvane.plans.models import MODEL_ID, SCORED
from hostvane.plans.registry import query, rounded, with_ctes
from hostvane.plans.tables import table
from hostvane.session import scratch_path
from hostvane.sources.telemetry import telemetry_from_events
from hostvane.streaming import fused, jobs, sliced

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of telemetry."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return telemetry_from_events(events)


def to_the_end(spark: SparkSession, sf_dir: str, start) -> None:
    """Run ``start(stream)`` over all events, say that no more will come, and run it once more."""
    folder = scratch_path(spark, "closing")
    stream = jobs.with_closing(event_stream(spark, sf_dir), folder)
    jobs.finish(start(stream))
    jobs.close_input(spark, folder, stream.schema)
    jobs.finish(start(stream))


def run_to_table(spark: SparkSession, sf_dir: str, build, label: str) -> DataFrame:
    """All rows of the stream ``build(telemetry)``, through a table."""
    path, log, schema = scratch_path(spark, label), scratch_path(spark, f"{label}-log"), []

    def start(telemetry: DataFrame):
        out = build(telemetry)
        schema.append(out.schema)
        return jobs.to_table(out, path, log)

    to_the_end(spark, sf_dir, start)
    return spark.read.schema(schema[0]).parquet(path)


@query(
    "stream_downsample",
    with_ctes(
        T,
        select=f"""
    SELECT run_id, {bucket(3600)} AS ts, count(*) AS count, round(count_if(is_anomaly) / count(*), 6) AS anomaly_rate,
           round(avg(cpu_usage), 6) AS cpu_usage_mean, round(quantile_cont(cpu_usage, 0.95), 6) AS cpu_usage_p95
    FROM telemetry GROUP BY 1, 2""",
    ),
)
def stream_downsample(spark, sf_dir):
    session = jobs.stream_session(spark)

    def build(telemetry: DataFrame) -> DataFrame:
        return jobs.stream_series(telemetry, ["cpu_usage"], ["mean", "p95"]).withColumn("ts", jobs.zoneless("ts"))

    return rounded(run_to_table(session, sf_dir, build, "series"))


@query(
    "stream_downsample_sketch",
    with_ctes(
        T,
        select=f"""
    SELECT run_id, {bucket(3600)} AS ts, count(*) AS count, round(count_if(is_anomaly) / count(*), 6) AS anomaly_rate,
           round(quantile_disc(cpu_usage, 0.5), 6) AS cpu_usage_p50, round(quantile_disc(cpu_usage, 0.95), 6) AS cpu_usage_p95
    FROM telemetry GROUP BY 1, 2""",
    ),
)
def stream_downsample_sketch(spark, sf_dir):
    """Quantiles from state of bounded size, which has every value of buckets as small as these."""
    session = jobs.stream_session(spark)

    def build(telemetry: DataFrame) -> DataFrame:
        series = jobs.stream_series(telemetry, ["cpu_usage"], ["p50", "p95"], exact=False)
        return series.withColumn("ts", jobs.zoneless("ts"))

    return rounded(run_to_table(session, sf_dir, build, "sketched"))


@query(
    "stream_scores",
    with_ctes(
        T,
        SCORED,
        select="""SELECT dataset_id, model_run_id, record_id, round(reconstruction_error, 6) AS reconstruction_error,
        predicted_is_anomaly FROM scored""",
    ),
)
def stream_scores(spark, sf_dir):
    session = jobs.stream_session(spark)
    path = scratch_path(spark, "scores")
    stream = jobs.stream_scores(event_stream(session, sf_dir), DEFAULT_MODEL, MODEL_ID)
    jobs.finish(jobs.to_table(stream, path, scratch_path(spark, "scores-log")))
    return rounded(spark.read.schema(stream.schema).parquet(path))


@query(
    "stream_fused",
    fused_sql(
        """run_id, host_id, metric_timestamp, record_id, a_flag, round(a_score, 6) AS a_score, b_ran, b_flag,
        round(b_score, 6) AS b_score, alert""",
    ),
)
def stream_fused(spark, sf_dir):
    session = jobs.stream_session(spark)
    dropped = ("details", "severity", "detector_source", "score")
    done = run_to_table(session, sf_dir, lambda t: fused.stream_fused(t, PIPELINE).drop(*dropped), "fused")
    return rounded(done.withColumn("metric_timestamp", jobs.zoneless("metric_timestamp")))


@query(
    "stream_fused_sliced",
    fused_sql(
        """run_id, host_id, metric_timestamp, record_id, a_flag, round(a_score, 6) AS a_score, b_ran, b_flag,
        round(b_score, 6) AS b_score, alert""",
    ),
)
def stream_fused_sliced(spark, sf_dir):
    """The events in two micro-batches; hosts with more than 300 rows in one are cut into slices."""
    session, folder = jobs.stream_session(spark), scratch_path(spark, "sliced-input")
    events = table(spark, sf_dir, "events")
    store, log, closing = scratch_path(spark, "sliced"), scratch_path(spark, "sliced-log"), scratch_path(spark, "closing")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    earlier = F.col("ts") <= F.lit(first + (last - first) / 2)
    for part in (earlier, ~earlier, None):
        if part is not None:
            events.where(part).write.mode("append").parquet(folder)
        stream = telemetry_from_events(session.readStream.schema(events.schema).parquet(folder))
        stream = jobs.with_closing(stream, closing)
        if part is None:
            jobs.close_input(session, closing, stream.schema)
        jobs.finish(sliced.stream_fused_sliced(stream, store, log, PIPELINE, slice_rows=300))
    done = sliced.read_verdicts(spark, store).drop("details", "severity", "detector_source", "score")
    return rounded(done)


def store_alerts(spark: SparkSession, sf_dir: str, path: str, sink: str, part: str = "true") -> DataFrame:
    """Run the alerts of some runs into the table at ``path`` under the name ``sink``; all alerts there."""
    log, schema = scratch_path(spark, f"{sink}-log"), []

    def start(telemetry: DataFrame):
        alerts = fused.stream_alerts(telemetry.where(f"run_id IS NULL OR ({part})"), PIPELINE)
        schema.append(alerts.schema)
        return jobs.alerts_to_table(alerts, path, log, sink)

    to_the_end(spark, sf_dir, start)
    done = jobs.read_alerts(spark, path, schema[0]).drop("sink")
    return rounded(done.withColumn("timestamp", jobs.zoneless("timestamp")))


@query("stream_alerts", fused_sql(FUSED_ALERT, "alert"))
def stream_alerts(spark, sf_dir):
    return store_alerts(jobs.stream_session(spark), sf_dir, scratch_path(spark, "alerts"), "all")


@query("stream_alerts_two_sinks", fused_sql(FUSED_ALERT, "alert"))
def stream_alerts_two_sinks(spark, sf_dir):
    """Two streams, each with some of the runs, into one table; one of them runs again after losing its checkpoint."""
    session, path = jobs.stream_session(spark), scratch_path(spark, "alerts")
    store_alerts(session, sf_dir, path, "first", "run_id = 'run-0'")
    store_alerts(session, sf_dir, path, "second", "run_id != 'run-0'")
    return store_alerts(session, sf_dir, path, "second", "run_id != 'run-0'")


@query(
    "stream_late_rows",
    f"""
    WITH parts AS (SELECT event_id % 10 = 0 AS behind, ts FROM events),
    mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS edge FROM parts WHERE NOT behind)
    SELECT count(*) AS rows_in, count(*) FILTER (WHERE behind AND ts <= edge) AS late,
           count(*) FILTER (WHERE NOT (behind AND ts <= edge)) AS emitted FROM parts, mark""",
)
def stream_late_rows(spark, sf_dir):
    """A tenth of the events arrives after all others: rows behind the watermark are dropped and counted."""
    session, folder = jobs.stream_session(spark), scratch_path(spark, "late-input")
    events = table(spark, sf_dir, "events")
    path, log, closing = scratch_path(spark, "late"), scratch_path(spark, "late-log"), scratch_path(spark, "closing")
    late = 0
    for part in ("event_id % 10 != 0", "event_id % 10 = 0", None):
        if part:
            events.where(part).coalesce(1).write.mode("append").parquet(folder)
        stream = telemetry_from_events(session.readStream.schema(events.schema).parquet(folder))
        stream = jobs.with_closing(stream, closing)
        if not part:
            jobs.close_input(session, closing, stream.schema)
        out = fused.stream_fused(stream, PIPELINE).select("record_id")
        late += jobs.finish_counting(jobs.to_table(out, path, log))
    emitted = spark.read.schema("record_id long").parquet(path)
    counted = emitted.agg(F.count(F.lit(1)).alias("emitted"))
    return counted.select(F.lit(events.count()).alias("rows_in"), F.lit(late).alias("late"), "emitted")
