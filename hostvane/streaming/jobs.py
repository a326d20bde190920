"""Stateless and windowed streaming jobs over telemetry, and stream sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hostvane.functions.pca import PcaModel, score
from hostvane.operators.analytics import series_aggregates
from hostvane.operators.detect import epoch_micros
from hostvane.operators.ranks import quantile_columns
from hostvane.schemas import FEATURES, telemetry_schema

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"
KLL_K = 2000


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, off the heap."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for inherited in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(inherited, spark.conf.get(inherited))
    return session


def read_telemetry_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, ts_type: T.DataType | None = None, **options
) -> DataFrame:
    """New files of a telemetry table as a stream; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(telemetry_schema(ts_type)).option("maxFilesPerTrigger", files_per_trigger)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(path)


def with_event_time(telemetry: DataFrame, delay: str = DELAY) -> DataFrame:
    """Event time as an instant (zoneless times are read as UTC), with a watermark."""
    instant = F.timestamp_micros(epoch_micros(telemetry, "metric_timestamp"))
    return telemetry.withColumn("metric_timestamp", instant).withWatermark("metric_timestamp", delay)


def zoneless(column: str):
    """An instant as its UTC wall time, independent of the session time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz"))


def sketch_columns(metrics: Sequence[str], aggs: Sequence[str], k: int = KLL_K):
    """(aggregates, columns that pick quantiles out of them): one sketch of at most a few ``k`` values per metric."""
    points = {"p50": 0.5, "p95": 0.95}
    wanted = [(m, a) for m in metrics for a in aggs if a in points]
    sketches = [F.expr(f"kll_sketch_agg_double({m}, {k})").alias(f"_s_{m}") for m in dict.fromkeys(m for m, _ in wanted)]
    picks = {f"{m}_{a}": F.expr(f"kll_sketch_get_quantile_double(_s_{m}, {points[a]}D)") for m, a in wanted}
    return sketches, picks


def stream_series(
    telemetry: DataFrame,
    metrics: Sequence[str],
    aggs: Sequence[str] = ("mean",),
    seconds: int = 3600,
    delay: str = DELAY,
    exact: bool = True,
    k: int = KLL_K,
) -> DataFrame:
    """Metrics and anomaly rate per run and bucket; a bucket is emitted once the watermark passes its end.

    Exact quantiles keep the values of a bucket in its state. With ``exact`` off, the state is one sketch per metric whose
    size does not grow with the rows: quantiles are nearest ranks, with a rank error of about 1.7 / k^0.9 of
    the rows (0.2 % at the usual ``k``), and none in buckets of up to ``k`` rows.
    """
    plain, quantiles = series_aggregates(metrics, aggs)
    if exact:
        kept, named = quantile_columns(quantiles)
        picks = dict(zip(quantiles, named))
    else:
        kept, picks = sketch_columns(metrics, aggs, k)
    return (
        with_event_time(telemetry, delay)
        .groupBy("run_id", F.window("metric_timestamp", f"{seconds} seconds").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            (F.count_if("is_anomaly") / F.count(F.lit(1))).alias("anomaly_rate"),
            *plain,
            *kept,
        )
        .withColumns(picks)
        .select("run_id", F.col("bucket.start").alias("ts"), "count", "anomaly_rate", *[f"{m}_{a}" for m in metrics for a in aggs])
    )


def stream_scores(telemetry: DataFrame, model: PcaModel, model_run_id: str) -> DataFrame:
    """Scores of rows as they arrive; no state."""
    return score(telemetry.select("run_id", "record_id", *FEATURES), model).select(
        F.col("run_id").alias("dataset_id"),
        F.lit(model_run_id).alias("model_run_id"),
        "record_id",
        "reconstruction_error",
        "predicted_is_anomaly",
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table; the sink's log makes a replayed batch count once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def alerts_to_table(alerts: DataFrame, path: str, checkpoint: str, sink: str) -> StreamingQuery:
    """Write each batch of alerts to a folder of its own under the stable name of this stream.

    A replayed batch replaces what it wrote before, and streams with other names are left alone. After a lost
    checkpoint the same alerts may come in other batches: ``read_alerts`` drops such repeats within a sink.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/sink={sink}/batch={batch_id}")

    return (
        alerts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The alerts of all streams into ``path`` with the ``sink`` that wrote them, each once per sink.

    Streams of other settings may alert on the same record; those are alerts of their own.
    """
    named = T.StructType([*schema.fields, T.StructField("sink", T.StringType())])
    rows = spark.read.schema(named).option("basePath", path).parquet(f"{path}/sink=*/batch=*")
    rows = rows.select(*named.names)
    return rows.dropDuplicates(["sink", "run_id", "record_id"])


def with_closing(telemetry: DataFrame, folder: str) -> DataFrame:
    """``telemetry`` and the closing row that ``close_input`` may write to ``folder`` later."""
    spark = telemetry.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return telemetry.unionByName(spark.readStream.schema(telemetry.schema).parquet(folder))


def close_input(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Say that no more rows will come: a row of no run, far in the future, moves the watermark past all others.

    Run the query once more with its checkpoint: everything that was waiting for later rows comes out. The closing row itself
    never does.
    """
    at = F.lit("2200-01-01 00:00:00").cast(schema["metric_timestamp"].dataType)
    fields = [at.alias(f.name) if f.name == "metric_timestamp" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*fields).coalesce(1).write.mode("append").parquet(folder)


def finish(query: StreamingQuery, timeout_seconds: int | None = None) -> StreamingQuery:
    """Wait until everything available was processed; a failure or a timeout is raised here."""
    ended = query.awaitTermination(timeout_seconds)
    if timeout_seconds is not None and not ended:
        query.stop()
        raise TimeoutError(f"stream did not finish in {timeout_seconds} seconds")
    return query


def finish_counting(query: StreamingQuery, timeout_seconds: int = 86_400) -> int:
    """Wait like ``finish``; the number of rows that came too late and were dropped by stateful steps."""
    dropped: dict[int, int] = {}

    def note() -> None:
        for progress in query.recentProgress:
            steps = progress["stateOperators"] if isinstance(progress, dict) else progress.stateOperators
            late = sum(s["numRowsDroppedByWatermark"] if isinstance(s, dict) else s.numRowsDroppedByWatermark for s in steps)
            batch = progress["batchId"] if isinstance(progress, dict) else progress.batchId
            dropped[batch] = max(late, dropped.get(batch, 0))

    waited = 0
    while not query.awaitTermination(1):  # only the latest progress reports are kept
        note()
        waited += 1
        if waited >= timeout_seconds:
            query.stop()
            raise TimeoutError(f"stream did not finish in {timeout_seconds} seconds")
    note()
    return sum(dropped.values())
