"""The fused pipeline over a stream: the batch step function behind a reordering buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostvane.functions.detectors import PipelineConfig, pack, unpack
from hostvane.operators.detect import (
    ERROR,
    FUSED_COLUMNS,
    IDENTITY,
    MICROS,
    MODEL_FLAG,
    FusedFold,
    alerts_only,
    fused_input,
    with_details,
)
from hostvane.operators.sequences import POSITION
from hostvane.schemas import FEATURES, HOST_KEYS
from hostvane.streaming.jobs import DELAY

IDLE_MS = 30 * 24 * 3600 * 1000  # a host is forgotten after 30 silent days, so state does not grow for ever
CHUNK_ROWS = 1000  # rows of a host that wait together
RELEASE_ROWS = 20_000  # rows of a host that advance the detectors together, but for chunks that overlap
BUFFERED = ("record_id", MICROS, *FEATURES, ERROR, MODEL_FLAG)
WAITING = pa.schema(
    [("record_id", pa.int64()), (MICROS, pa.int64()), *((f, pa.float64()) for f in (*FEATURES, ERROR)), (MODEL_FLAG, pa.bool_())]
)
CHUNK_SCHEMA = T.StructType([T.StructField("first", T.LongType()), T.StructField("chunk", T.LongType())])
ROWS_SCHEMA = T.StructType([T.StructField("rows", T.BinaryType())])
HOST_SCHEMA = T.StructType(
    [
        T.StructField("detectors", T.BinaryType()),
        T.StructField("position", T.LongType()),
        T.StructField("released", T.LongType()),
        T.StructField("chunks", T.LongType()),
    ]
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("host_id", T.StringType()),
        T.StructField(MICROS, T.LongType()),
        T.StructField("record_id", T.LongType()),
        *FusedFold.result,
    ]
)


def to_bytes(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, schema=WAITING, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(chunk).read_pandas()


def in_time_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values([MICROS, "record_id"], ignore_index=True)


class FusedProcessor(StatefulProcessor):
    """One host. Rows wait until the watermark passes them, then advance the detectors in time order.

    What a batch adds is written once, in time order, in chunks of at most CHUNK_ROWS rows named by their first time; so the calls
    of the state store grow with the chunks, not with the rows or their minutes. A timer reads only chunks whose first row is due; rows
    of these that are not due are written again. Rows are released about RELEASE_ROWS at a time.
    Rows behind the watermark never get here: Spark drops and counts them (``jobs.finish_counting``). With ``idle_ms``
    set, a host that stays silent that long in event time is forgotten.
    """

    def __init__(self, cfg: PipelineConfig, idle_ms: int | None = None):
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = FusedFold(self.cfg)
        self.host = handle.getValueState("host", HOST_SCHEMA)
        self.rows = handle.getMapState("rows", CHUNK_SCHEMA, ROWS_SCHEMA)
        self.judged = None  # (host, watermark) up to which rows were released; timers of a batch share a watermark

    def _load(self):
        if self.host.exists():
            detectors, *numbers = self.host.get()
            return bytes(detectors), *numbers
        return pack(self.fold.initial()), 0, -1, 0

    def _keep(self, rows: pd.DataFrame, chunks: int) -> int:
        """Write ``rows``, which are in time order, as chunks numbered from ``chunks`` on; the number after them."""
        for at in range(0, len(rows), CHUNK_ROWS):
            part = rows.iloc[at : at + CHUNK_ROWS]
            self.rows.updateValue((int(part[MICROS].iloc[0]), chunks), (to_bytes(part),))
            chunks += 1
        return chunks

    def _take(self, chunk: tuple[int, int]) -> pd.DataFrame:
        rows = from_bytes(bytes(self.rows.getValue(chunk)[0]))
        self.rows.removeKey(chunk)
        return rows

    def _due(self, reached: list[tuple[int, int]], watermark: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        """(rows to release, rows held back) of chunks that are opened in the order of their first rows: a row goes out when all
        chunks that may hold earlier ones are open."""
        held, size, enough = [], 0, RELEASE_ROWS
        for i, chunk in enumerate(reached):
            held.append(self._take(chunk))
            size += len(held[-1])
            last = i + 1 == len(reached)
            if size < enough and not last:
                continue
            rows = in_time_order(pd.concat(held, ignore_index=True))
            until = watermark + 1 if last else reached[i + 1][0]
            n = int(rows[MICROS].searchsorted(until))
            held, size = [rows.iloc[n:]], len(rows) - n
            enough = max(RELEASE_ROWS, 2 * size)
            yield rows.iloc[:n], held[0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        detectors, position, released, chunks = self._load()
        first = None
        for frame in rows:
            fresh = in_time_order(frame[list(BUFFERED)].astype({MICROS: "int64"}))
            if len(fresh):
                chunks = self._keep(fresh, chunks)
                first = min(int(fresh[MICROS].iloc[0]), first if first is not None else int(fresh[MICROS].iloc[0]))
        self.host.update((detectors, position, released, chunks))
        if first is not None:
            self._wake(first, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.judged == (key, watermark):
            return
        self.judged = (key, watermark)
        waiting = sorted((first, chunk) for first, chunk in self.rows.keys())
        reached = [chunk for chunk in waiting if chunk[0] <= watermark]
        packed, position, released, chunks = self._load()
        left = [first for first, _ in waiting[len(reached) :]]
        if reached:
            detectors, rest = unpack(packed), None
            for rows, rest in self._due(reached, watermark):
                if not len(rows):
                    continue
                columns = {c: rows[c].to_numpy() for c in BUFFERED}
                columns[POSITION] = np.arange(position, position + len(rows), dtype="int64")
                columns[MODEL_FLAG] = columns[MODEL_FLAG].astype(bool)
                result, after = self.fold.run(columns, np.array([0]), np.array([len(rows)]), [detectors])
                detectors, position, released = after[0], position + len(rows), int(rows[MICROS].iloc[-1])
                head = pd.DataFrame(
                    {"run_id": key[0], "host_id": key[1], MICROS: rows[MICROS], "record_id": rows["record_id"]}
                )
                yield head.assign(**result)
            if len(rest):
                chunks = self._keep(rest, chunks)
                left.append(int(rest[MICROS].iloc[0]))
        if left:
            self._wake(min(left), timerValues)
        elif self.idle_ms is not None and released + self.idle_ms * 1000 <= watermark:
            self.host.clear()
            return
        if reached:
            self.host.update((pack(detectors), position, released, chunks))
            if self.idle_ms is not None:
                self.handle.registerTimer(released // 1000 + self.idle_ms)

    def _wake(self, micros: int, timerValues) -> None:
        """A timer fires when the watermark passes it; round up so the row is due by then."""
        self.handle.registerTimer(max(-(-micros // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def stream_fused(
    telemetry: DataFrame,
    cfg: PipelineConfig = PipelineConfig(),
    delay: str = DELAY,
    idle_ms: int | None = IDLE_MS,
) -> DataFrame:
    """Every row's verdicts, emitted once the watermark has passed it. Run it in a ``stream_session``."""
    rows = fused_input(telemetry, cfg)
    timed = rows.withColumn("event_time", F.timestamp_micros(MICROS)).withWatermark("event_time", delay)
    out = (
        timed.select(*HOST_KEYS, "record_id", "event_time", MICROS, *FEATURES, ERROR, MODEL_FLAG)
        .groupBy(*HOST_KEYS)
        .transformWithStateInPandas(
            statefulProcessor=FusedProcessor(cfg, idle_ms),
            outputStructType=RESULT_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    real = out.where("run_id IS NOT NULL OR record_id IS NOT NULL")  # not the row that closes the input
    return with_details(real).withColumn("metric_timestamp", F.timestamp_micros(MICROS)).select(
        *IDENTITY, *FUSED_COLUMNS
    )


def stream_alerts(
    telemetry: DataFrame, cfg: PipelineConfig = PipelineConfig(), delay: str = DELAY, idle_ms: int | None = IDLE_MS
) -> DataFrame:
    return alerts_only(stream_fused(telemetry, cfg, delay, idle_ms), "details")
