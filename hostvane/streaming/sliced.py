"""The fused pipeline over a stream whose hosts may be larger than a task.

``stream_fused`` keeps a host's rows and detectors in the state of one task. Here every micro-batch is a batch job over
what became due: hosts that fit a task are walked whole, larger ones are cut into slices that run in parallel, and both start from the
states stored by the batch before. Rows, states and verdicts are tables in a folder of the stream (``store``):

* ``arrived/batch=N``: rows that came with the batch, and those that still waited;
* ``states/batch=N``: detectors of the hosts that moved; every ``COMPACT`` batches of all hosts;
* ``verdicts/batch=N``: the result;
* ``mark/batch=N``: the time up to which rows were judged, written last. A batch without it does not count.

A batch reads only what batches before it wrote, so one that is run again after a failure replaces its own folders
and gives the same rows. Folders no replay needs are deleted; verdicts stay.

A row is due once a row ``delay`` later was seen. Rows without a time, or not after the mark of the batch before, come too late: they are
dropped and counted (``late_rows``). A host whose last row is ``idle_ms`` before the mark is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hostvane.functions.detectors import PipelineConfig, pack, unpack
from hostvane.operators.detect import (
    ERROR,
    FUSED_COLUMNS,
    IDENTITY,
    MICROS,
    MODEL_FIELDS,
    MODEL_FLAG,
    AlertFold,
    FusedFold,
    GateFold,
    PoisonFold,
    fused_input,
    with_details,
)
from hostvane.operators.folds import STATE, run_fold
from hostvane.operators.joins import join_checked
from hostvane.operators.sequences import POSITION, SLICE, SLICE_ROWS, HostRows, for_hosts
from hostvane.schemas import HOST_KEYS
from hostvane.session import materialize, scratch_within
from hostvane.sources import folders
from hostvane.streaming.fused import IDLE_MS

COMPACT = 16
BEFORE_ALL = -(2**62)
STEPS = ("stats", "gate", "alerts")
STATES = T.StructType(
    [T.StructField(k, T.StringType()) for k in HOST_KEYS]
    + [T.StructField(step, T.BinaryType()) for step in STEPS]
    + [T.StructField("position", T.LongType()), T.StructField("last_us", T.LongType())]
)
REAL = "run_id IS NOT NULL OR record_id IS NOT NULL"  # not the row that closes the input


def _whole(states: DataFrame) -> DataFrame:
    """One state per host as ``FusedFold`` takes it."""

    def joined(stats: pd.Series, gate: pd.Series, alerts: pd.Series) -> pd.Series:
        return pd.Series([pack(tuple(unpack(bytes(s)) for s in three)) for three in zip(stats, gate, alerts)], dtype=object)

    return states.select(*HOST_KEYS, F.pandas_udf(joined, T.BinaryType())(*STEPS).alias(STATE))


def _in_steps(whole: Column) -> Column:
    """A state of ``FusedFold`` as the states of the three steps; null stays null."""

    def cut(states: pd.Series) -> pd.DataFrame:
        parts = [[None] * len(STEPS) if s is None else [pack(p) for p in unpack(bytes(s))] for s in states]
        return pd.DataFrame(parts, columns=list(STEPS), dtype=object)

    return F.pandas_udf(cut, T.StructType([STATES[step] for step in STEPS]))(whole)


@dataclass(frozen=True)
class SlicedFused:
    """What one micro-batch does; for ``foreachBatch``."""

    store: str
    cfg: PipelineConfig
    delay_us: int
    idle_us: int
    slice_rows: int = SLICE_ROWS

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0 and folders.exists(spark, self._path("mark", 1)):
            raise ValueError(f"{self.store} belongs to a stream with another checkpoint")
        with scratch_within(spark, "micro-batch"):
            self._judge(spark, batch, number)
        self._clean(spark, number)

    def _path(self, table: str, number: int) -> str:
        return f"{self.store}/{table}/batch={number}"

    def _write(self, rows: DataFrame, table: str, number: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path(table, number))
        return rows.sparkSession.read.schema(rows.schema).parquet(self._path(table, number))

    def _judge(self, spark: SparkSession, batch: DataFrame, number: int) -> None:
        mark = read_mark(spark, self.store, number - 1)["mark"] if number else BEFORE_ALL
        rows = fused_input(batch, self.cfg)
        if number:
            before = spark.read.schema(rows.schema).parquet(self._path("arrived", number - 1))
            rows = rows.unionByName(before.where((F.col(MICROS) > mark) & F.expr(REAL)))
        arrived = self._write(rows, "arrived", number)
        ahead = F.coalesce(F.col(MICROS) > mark, F.lit(False))
        newest, late = arrived.agg(F.max(MICROS), F.count_if(~ahead & F.expr(REAL))).first()
        reached = mark if newest is None else max(mark, newest // 1000 * 1000 - self.delay_us)
        due = arrived.where(ahead & (F.col(MICROS) <= reached) & F.expr(REAL))
        known = self._known(spark, number - 1, mark)
        hosts = materialize(due.select(*HOST_KEYS).distinct(), "hosts")
        begin = materialize(join_checked(known, hosts, HOST_KEYS, "left_semi", stored=True), "begin")
        judged = materialize(for_hosts(due, lambda seq: self._verdicts(seq, begin), self.slice_rows), "judged")
        self._write(with_details(judged).select(*IDENTITY, *FUSED_COLUMNS), "verdicts", number)
        moved = self._moved(judged)
        if number % COMPACT == 0:
            awake = known.where(F.col("last_us") + self.idle_us > reached)
            moved = moved.unionByName(join_checked(awake, hosts, HOST_KEYS, "left_anti", stored=True))
        self._write(moved, "states", number)
        folders.write_text(spark, f"{self._path('mark', number)}/mark.json", json.dumps({"mark": reached, "late": late}))

    def _known(self, spark: SparkSession, number: int, mark: int) -> DataFrame:
        """The newest state of every host that is not forgotten, after batch ``number``."""
        if number < 0:
            return spark.createDataFrame([], STATES)
        parts = [self._path("states", k) for k in range(number - number % COMPACT, number + 1)]
        kind = T.StructType([*STATES.fields, T.StructField("batch", T.LongType())])
        rows = spark.read.schema(kind).option("basePath", f"{self.store}/states").parquet(*parts)
        rows = rows.where(F.col("last_us") + self.idle_us > mark)
        others = [c for c in STATES.names if c not in HOST_KEYS]
        newest = rows.groupBy(*HOST_KEYS).agg(F.max_by(F.struct(*others), "batch").alias("s"))
        return newest.select(*HOST_KEYS, *[F.col(f"s.{c}").alias(c) for c in others])

    def _verdicts(self, seq: HostRows, begin: DataFrame) -> DataFrame:
        """Rows with verdicts; in the last row of every slice the states after it, whole or by step."""
        shift = begin.select(*HOST_KEYS, F.col("position").alias("_shift"))
        rows = join_checked(seq.rows, shift, HOST_KEYS, "left", stored=True)
        rows = rows.withColumn(POSITION, F.col(POSITION) + F.coalesce("_shift", F.lit(0))).drop("_shift")
        base = (*IDENTITY, POSITION, SLICE, MICROS)
        if not seq.split:
            done = run_fold(replace(seq, rows=rows), FusedFold(self.cfg), base, _whole(begin))
            return done.withColumns({step: F.lit(None).cast("binary") for step in STEPS})

        def step(rows: DataFrame, fold, keep: Sequence[str], name: str) -> DataFrame:
            states = begin.select(*HOST_KEYS, F.col(name).alias(STATE))
            done = run_fold(replace(seq, rows=rows), fold, keep, states)
            return materialize(done.withColumnRenamed(STATE, name), "stage")

        judged = step(rows, PoisonFold(self.cfg.window, self.cfg.outliers), (*base, ERROR, MODEL_FLAG), "stats")
        found = ("a_flag", "a_score", "a_details", "stats")
        gated = step(judged.withColumnRenamed("details", "a_details"), GateFold(self.cfg.gate), (*base, *found), "gate")
        found = (*found, *[name for name, _ in MODEL_FIELDS], "gate")
        done = step(gated, AlertFold(self.cfg.alerts, self.cfg.model.threshold), (*base, *found), "alerts")
        return done.withColumn(STATE, F.lit(None).cast("binary"))

    def _moved(self, judged: DataFrame) -> DataFrame:
        """The states of hosts after all their rows. The state of alerts is passed on only to slices with flagged rows."""

        def newest(state: str) -> Column:
            return F.max_by(state, F.when(F.col(state).isNotNull(), F.col(POSITION))).alias(state)

        slices = judged.groupBy(*HOST_KEYS, SLICE).agg(
            *[newest(s) for s in (STATE, *STEPS)],
            (F.bool_or(F.expr(AlertFold.matters)) | (F.col(SLICE) == 0)).alias("_knows"),
            (F.max(POSITION) + 1).alias("position"),
            F.max(MICROS).alias("last_us"),
        )
        knowing = F.when(F.col("_knows"), F.col(SLICE))
        hosts = slices.groupBy(*HOST_KEYS).agg(
            *[F.max_by(s, knowing if s == "alerts" else SLICE).alias(s) for s in (STATE, *STEPS)],
            F.max("position").alias("position"),
            F.max("last_us").alias("last_us"),
        )
        cut = hosts.withColumn("_steps", _in_steps(F.col(STATE)))
        return cut.select(
            *HOST_KEYS, *[F.coalesce(f"_steps.{s}", s).alias(s) for s in STEPS], "position", "last_us"
        )

    def _clean(self, spark: SparkSession, number: int) -> None:
        """Delete what no replay of this batch, and no later one, will read."""
        if number >= 2:
            folders.remove(spark, self._path("arrived", number - 2))
        if number > COMPACT and number % COMPACT == 1:
            for k in range(number - 1 - COMPACT, number - 1):
                folders.remove(spark, self._path("states", k))


def stream_fused_sliced(
    telemetry: DataFrame,
    store: str,
    checkpoint: str,
    cfg: PipelineConfig = PipelineConfig(),
    delay_ms: int = 600_000,
    idle_ms: int = IDLE_MS,
    slice_rows: int = SLICE_ROWS,
) -> StreamingQuery:
    """Judge what is available into ``store``; read it with ``read_verdicts``. ``with_closing`` and ``close_input`` work here, too."""
    step = SlicedFused(store, cfg, delay_ms * 1000, idle_ms * 1000, slice_rows)
    return (
        telemetry.writeStream.foreachBatch(step.__call__)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_mark(spark: SparkSession, store: str, number: int) -> dict[str, int]:
    return json.loads(folders.read_text(spark, f"{store}/mark/batch={number}/mark.json"))


def _finished(spark: SparkSession, store: str) -> list[int]:
    marked = folders.folders(spark, f"{store}/mark/batch=*")
    return sorted(int(path.rsplit("=", 1)[1]) for path in marked if folders.exists(spark, f"{path}/mark.json"))


def late_rows(spark: SparkSession, store: str) -> int:
    return sum(read_mark(spark, store, k)["late"] for k in _finished(spark, store))


def read_verdicts(spark: SparkSession, store: str) -> DataFrame:
    """The verdicts of all finished batches."""
    return spark.read.parquet(*[f"{store}/verdicts/batch={k}" for k in _finished(spark, store)])
