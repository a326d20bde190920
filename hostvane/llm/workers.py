"""What Python workers hold between tasks."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession


TEXTS_AT_ONCE = 500


def slices(batch: pa.RecordBatch, rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch``, of which Spark bounds the bytes: Python objects are made of one part at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices_of_bytes(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with up to ``size`` bytes of a text or binary column; a longer value is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        limit = size + (ends[at - 1] if at else 0)
        stop = max(int(np.searchsorted(ends, limit, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def texts_of(series: pd.Series, rows: int = TEXTS_AT_ONCE) -> Iterator[list[str | None]]:
    """The texts of a column, a part at a time; nulls as None."""
    for at in range(0, len(series), rows):
        yield [t if isinstance(t, str) else None for t in series.iloc[at : at + rows]]


THINGS_KEPT = 2


def _kept() -> dict[str, Any]:
    state = sys.modules.setdefault("hostvane_worker_state", types.ModuleType("hostvane_worker_state"))
    return state.__dict__.setdefault("kept", {})


def per_worker(name: str, make: Callable[[], Any], others: int = THINGS_KEPT - 1) -> Any:
    """``make()`` once per Python worker: workers serve many tasks, and loading or warming up is not free.

    Only the things used last stay, so a worker does not gather the models of all jobs it has served: of ``others`` at most as
    many as given, and they go before the new one is made.
    """
    kept = _kept()
    known = name in kept
    thing = kept.pop(name, None)
    _drop(kept, others)
    thing = thing if known else make()
    kept[name] = thing
    return thing


def let_go() -> None:
    """Drop what earlier jobs left with this worker: for steps that need nothing of it."""
    _drop(_kept(), 0)


def _drop(kept: dict[str, Any], left: int) -> None:
    if len(kept) > left:
        while len(kept) > left:
            kept.pop(next(iter(kept)))
        gc.collect()  # things may refer to themselves
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which allocators else keep: workers of an executor share one limit with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared(spark: SparkSession, model: Any) -> Callable[[], Any]:
    """A function that gives ``model`` (of bounded size) on any worker. Its class travels with it."""
    sent, name = spark.sparkContext.broadcast(cloudpickle.dumps(model)), uuid.uuid4().hex
    return lambda: per_worker(name, lambda: pickle.loads(sent.value))
