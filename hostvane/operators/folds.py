"""Running a step function over every host's rows in order, in parallel even inside one host.

A host's rows are cut into slices of bounded length. Small hosts are one slice and start from the
initial state. For larger ones the state at the start of a slice is the state at the end of the slice
before, which is not known while slices run in parallel. There are two ways to find it, both exact.

Folds whose effect has a short form (``summarize``): every slice is summarized as a function of the state
before it, all slices at once. Summaries compose, so neighbouring ones are joined as a tree; the top is followed
from slice to slice, and states go back down.

Other folds: every slice that has a successor runs once from a guessed start, giving an end state. Each
host's chain of (start, end) digests is walked from its exact first slice. Where the start a slice needs
was already tried, the walk goes on; otherwise that slice is run from the state it needs. This repeats
until every chain is walked to its end. A rolling history forgets: after enough rows the end of a slice no
longer depends on how it began, so one repetition usually suffices. Each completes at least one more slice
of every open chain, so it ends in any case, and the result never depends on the guesses.

Once all starts are known, one last pass produces the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from hostvane.functions.detectors import pack, unpack
from hostvane.operators.joins import join_checked
from hostvane.operators.sequences import POSITION, SLICE, HostRows
from hostvane.session import materialize

STATE, START = "_state", "_start"
FAN = 256  # summaries that one task composes or follows
GUESSED = ""  # digest that stands for the initial state


Columns = Mapping[str, np.ndarray]


class Fold(Protocol):
    columns: Sequence[str]  # what the step reads, besides keys and position
    result: T.StructType  # what it adds to each row

    def initial(self) -> Any: ...

    def run(self, rows: Columns, starts: np.ndarray, ends: np.ndarray, states: list) -> tuple[Columns, list]:
        """Advance the hosts at rows[starts[i]:ends[i]]; results in row order, and the states after."""
        ...


class ShortFold(Fold, Protocol):
    matters: str  # SQL condition for the rows that can change the state

    def summarize(self, rows: Columns) -> str:
        """The effect of one slice's rows on any state before them."""
        ...

    def follow(self, state: Any, summary: str) -> Any: ...

    def compose(self, first: str, then: str) -> str:
        """The effect of two neighbouring slices together."""
        ...


def digest(state: bytes) -> str:
    return hashlib.md5(state).hexdigest()


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> Columns:
    """Numeric columns as numpy arrays. Only marker rows hold NULL, and no fold looks at those."""
    out = {}
    for name in names:
        column = batch.column(name)
        if column.null_count:
            column = pc.fill_null(column, pa.scalar(0).cast(column.type))
        out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _starts_of(batch: pa.RecordBatch, ids: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """Rows at which the ids change, and the ids there."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in ids:
        column = batch.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    return starts, list(zip(*(batch.column(c).take(pa.array(starts)).to_pylist() for c in ids)))


def _segments(batches: Iterator[pa.RecordBatch], ids: Sequence[str], fold: Fold):
    """Per Arrow batch: (batch, ids of segments, starts, ends, states before). A row with a state
    precedes its segment and sets where it starts. Call ``send`` with the states after."""
    open_id, open_state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, names = _starts_of(batch, ids)
        ends = np.append(starts[1:], batch.num_rows)
        markers = batch.column(STATE).take(pa.array(starts)).to_pylist()
        states = []
        for i, (name, marker) in enumerate(zip(names, markers)):
            if marker is not None:
                states.append(unpack(marker))
            elif i == 0 and name == open_id:
                states.append(open_state)
            else:
                states.append(fold.initial())
        given = np.array([m is not None for m in markers], dtype=int)
        after = yield batch, names, starts + given, ends, states
        open_id, open_state = names[-1], after[-1]


def _advance(fold: Fold, batch, starts, ends, states):
    """Run the fold on the segments that have rows in this batch."""
    some = np.flatnonzero(ends > starts)
    if len(some) == 0:
        return None, list(states)
    rows = _numbers(batch, [POSITION, *fold.columns])
    result, moved = fold.run(rows, starts[some], ends[some], [states[i] for i in some])
    after = list(states)
    for i, state in zip(some, moved):
        after[i] = state
    return result, after


# Arrow types of the results a fold may have.
ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def _states_after(n: int, ends: np.ndarray, starts: np.ndarray, after: list) -> pa.Array:
    """The state after each segment, in its last row of this batch."""
    states = [None] * n
    for i in np.flatnonzero(ends > starts):
        states[ends[i] - 1] = pack(after[i])
    return pa.array(states, pa.binary())


def _emit_rows(fold: Fold, ids: Sequence[str], keep: Sequence[str], with_states: bool = False):
    kinds = {f.name: ARROW[f.dataType.simpleString()] for f in fold.result}
    shown = [STATE] if with_states else []

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _segments(batches, ids, fold)
        step = next(walk, None)
        while step is not None:
            batch, _, starts, ends, states = step
            result, after = _advance(fold, batch, starts, ends, states)
            if result is not None:
                arrays = [batch.column(c) for c in keep]
                # NaN stands for "no value" in a result
                arrays += [pa.array(result[name], type=kind, from_pandas=True) for name, kind in kinds.items()]
                arrays += [_states_after(batch.num_rows, ends, starts, after) for _ in shown]
                out = pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds, *shown])
                markers = batch.column(STATE)
                yield out if markers.null_count == batch.num_rows else out.filter(markers.is_null())
            try:
                step = walk.send(after)
            except StopIteration:
                step = None

    return emit


def _emit_ends(fold: Fold, ids: Sequence[str], schema: pa.Schema):
    def ends_batch(done: list) -> pa.RecordBatch:
        packed = [pack(state) for _, state in done]
        columns = [*zip(*(name for name, _ in done)), [digest(p) for p in packed], packed]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _segments(batches, ids, fold)
        step = next(walk, None)
        open_name, open_state = None, None
        while step is not None:
            batch, names, starts, ends, states = step
            _, after = _advance(fold, batch, starts, ends, states)
            done = []
            if open_name is not None and open_name != names[0]:
                done.append((open_name, open_state))
            done.extend(zip(names[:-1], after[:-1]))
            open_name, open_state = names[-1], after[-1]
            if done:
                yield ends_batch(done)
            try:
                step = walk.send(after)
            except StopIteration:
                step = None
        if open_name is not None:
            yield ends_batch([(open_name, open_state)])

    return emit


def run_fold(seq: HostRows, fold: Fold, keep: Sequence[str], begin: DataFrame | None = None) -> DataFrame:
    """``keep`` columns of every row plus the fold's results, exact for hosts of any size.

    With ``begin`` (keys and a packed state, at most one row a host) those hosts start from their state instead of the initial
    one, and the column ``STATE`` holds, in the last row of every slice and in some rows before, the state after that row.
    """
    keys = list(seq.keys)
    needed = list(dict.fromkeys([*keys, SLICE, POSITION, *keep, *fold.columns]))
    rows = seq.rows.select(*needed)
    ids = [*keys, SLICE]
    if seq.split:
        found = _followed_starts if hasattr(fold, "summarize") else _tried_starts
        starts = found(rows, fold, keys, begin=begin).select(*ids, STATE)
    if begin is not None:
        first = begin.select(*keys, F.lit(0).cast(rows.schema[SLICE].dataType).alias(SLICE), STATE)
        starts = first.unionByName(starts.where(F.col(SLICE) > 0)) if seq.split else first
    if seq.split or begin is not None:
        rows = rows.unionByName(_marker_rows(starts, rows, keys), allowMissingColumns=True)
    else:
        rows = rows.withColumn(STATE, F.lit(None).cast("binary"))
    states = [] if begin is None else [T.StructField(STATE, T.BinaryType())]
    schema = T.StructType([rows.schema[c] for c in keep] + list(fold.result) + states)
    for f in schema:
        f.nullable = True
    # Unsplit rows come out of the numbering window, which has already gathered each host in one task.
    placed = rows.repartition(*ids) if seq.split or begin is not None else rows
    return placed.sortWithinPartitions(*ids, POSITION).mapInArrow(_emit_rows(fold, ids, keep, bool(states)), schema)


def _marker_rows(starts: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that sort before their slice and carry the state it starts from."""
    others = [c for c in rows.columns if c not in (*keys, SLICE, POSITION)]
    return starts.select(
        *keys,
        SLICE,
        STATE,
        F.lit(-1).cast("long").alias(POSITION),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others],
    )


def _followed_starts(
    rows: DataFrame, fold: ShortFold, keys: list[str], fan: int | None = None, begin: DataFrame | None = None
) -> DataFrame:
    """(keys, slice, state) for every slice of a large host, by summaries.

    Summaries of neighbouring slices are composed, ``fan`` at a time, until a host has few enough for one task to follow. States
    then go back down the tree the same way, so the number of rounds grows with the logarithm of the slices.
    """
    fan = fan or FAN
    ids = [*keys, SLICE]
    large = rows.where(F.col(SLICE) > 0).select(*keys).distinct()
    inner = join_checked(rows.select(*ids, POSITION, *fold.columns).where(fold.matters), large, keys, "left_semi")
    schema = T.StructType([rows.schema[c] for c in ids] + [T.StructField("summary", T.StringType())])
    summaries = inner.repartition(*ids).sortWithinPartitions(*ids, POSITION).mapInArrow(_emit_summaries(fold, ids, to_arrow_schema(schema)), schema)
    most = rows.agg(F.max(SLICE)).first()[0] or 0
    levels = [summaries if most < fan else materialize(summaries, "summaries")]
    while most >= fan:
        most //= fan
        grouped = levels[-1].withColumn("_place", F.col(SLICE)).withColumn(SLICE, F.expr(f"{SLICE} div {fan}").cast(rows.schema[SLICE].dataType))
        placed = grouped.repartition(*ids).sortWithinPartitions(*ids, "_place")
        levels.append(materialize(placed.mapInPandas(_emit_composed(fold, ids), schema), "summaries"))
    state = T.StructType([rows.schema[c] for c in ids] + [T.StructField(STATE, T.BinaryType())])
    top = levels.pop()
    if begin is not None:
        before = begin.select(*keys, F.lit(-1).cast(rows.schema[SLICE].dataType).alias(SLICE), STATE)
        top = top.unionByName(before, allowMissingColumns=True)
    states = top.repartition(*keys).sortWithinPartitions(*ids).mapInPandas(_emit_starts(fold, keys), state)
    while levels:
        below = levels.pop().withColumn("_above", F.expr(f"{SLICE} div {fan}").cast(rows.schema[SLICE].dataType))
        known = states.select(*keys, F.col(SLICE).alias("_above"), F.lit(-1).cast(rows.schema[SLICE].dataType).alias(SLICE), STATE)
        both = below.unionByName(known, allowMissingColumns=True)
        placed = both.repartition(*keys, "_above").sortWithinPartitions(*keys, "_above", SLICE)
        states = placed.mapInPandas(_emit_starts(fold, [*keys, "_above"], len(keys)), state)
    return states


def _emit_composed(fold: ShortFold, ids: Sequence[str]):
    """The joint effect of neighbouring slices, in order."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, text = None, None
        for batch in batches:
            done = []
            for row in batch[[*ids, "summary"]].itertuples(index=False, name=None):
                key, own = row[:-1], row[-1]
                if key == name:
                    text = fold.compose(text, own)
                else:
                    if name is not None:
                        done.append((*name, text))
                    name, text = key, own
            yield pd.DataFrame(done, columns=[*ids, "summary"])
        if name is not None:
            yield pd.DataFrame([(*name, text)], columns=[*ids, "summary"])

    return emit


def _emit_summaries(fold: ShortFold, ids: Sequence[str], schema: pa.Schema):
    """Gathers one slice at a time; a slice has a bounded number of rows."""

    columns = (POSITION, *fold.columns)

    def shown(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    def summary(name: tuple, parts: list[Columns]) -> tuple:
        return (*name, fold.summarize({c: np.concatenate([p[c] for p in parts]) for c in columns}))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, names = _starts_of(batch, ids)
            rows, done = _numbers(batch, columns), []
            for key, a, b in zip(names, starts, [*starts[1:], batch.num_rows]):
                if key != name and parts:
                    done.append(summary(name, parts))
                    parts = []
                name = key
                parts.append({c: rows[c][a:b] for c in columns})
            if done:
                yield shown(done)
        if parts:
            yield shown([summary(name, parts)])

    return emit


def _emit_starts(fold: ShortFold, keys: Sequence[str], shown: int | None = None):
    """Follows each group from slice to slice, holding nothing but the current state. A row with a state says where
    its group starts; ``shown`` of the keys are given out."""
    shown = len(keys) if shown is None else shown
    columns = [*keys[:shown], SLICE, STATE]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, None
        for batch in batches:
            out = []
            given = batch[STATE] if STATE in batch else [None] * len(batch)
            for row, start in zip(batch[[*keys, SLICE, "summary"]].itertuples(index=False, name=None), given):
                *key, place, text = row
                if key != host:
                    host, state = key, fold.initial()
                if place < 0:
                    state = unpack(bytes(start))
                    continue
                out.append((*key[:shown], place, pack(state)))
                state = fold.follow(state, text)
            yield pd.DataFrame(out, columns=columns)

    return emit


def _tried_starts(rows: DataFrame, fold: Fold, keys: list[str], begin: DataFrame | None = None) -> DataFrame:
    """(keys, slice, state) for every later slice of a large host, by trying starts."""
    chain = Window.partitionBy(*keys).orderBy(SLICE)
    slices = rows.select(*keys, SLICE).distinct().withColumn("_next", F.lead(SLICE).over(chain))
    slices = materialize(slices.where(F.col("_next").isNotNull()), "slices")
    inner = join_checked(rows, slices.select(*keys, SLICE), [*keys, SLICE], "left_semi")
    if begin is not None:  # exact for the first slices, as the guess is for hosts without a state
        begin = begin.select(*keys, F.lit(0).cast(rows.schema[SLICE].dataType).alias(SLICE), F.lit(GUESSED).alias(START), STATE)
    tried = materialize(_ends(inner.withColumn(START, F.lit(GUESSED)), begin, fold, keys), "ends").withColumn(
        "_round", F.lit(0)
    )
    turn = 0
    while True:
        turn += 1
        walked = materialize(_walk(tried, slices, keys, turn), "walk")
        wanted = walked.where("try")
        if wanted.isEmpty():
            break
        wanted = wanted.select(*keys, SLICE, START)
        again = join_checked(rows, wanted, [*keys, SLICE])
        ends = _ends(again, _states(wanted, tried, keys), fold, keys)
        tried = tried.unionByName(materialize(ends, "ends").withColumn("_round", F.lit(turn)))
    return _states(walked.where(~F.col("try")).select(*keys, SLICE, START), tried, keys)


def _states(starts: DataFrame, tried: DataFrame, keys: list[str]) -> DataFrame:
    """Attach to (keys, slice, start digest) the state with that digest."""
    known = tried.select(*keys, F.col("end_id").alias(START), F.col("end_state").alias(STATE))
    return starts.join(known.dropDuplicates([*keys, START]), [*keys, START])


def _ends(rows: DataFrame, starts: DataFrame | None, fold: Fold, keys: list[str]) -> DataFrame:
    """End state of every (slice, start) among ``rows``."""
    ids = [*keys, SLICE, START]
    if starts is None:
        rows = rows.withColumn(STATE, F.lit(None).cast("binary"))
    else:
        rows = rows.unionByName(starts.withColumn(POSITION, F.lit(-1).cast("long")), allowMissingColumns=True)
    schema = T.StructType(
        [rows.schema[c] for c in ids]
        + [T.StructField("end_id", T.StringType()), T.StructField("end_state", T.BinaryType())]
    )
    emit = _emit_ends(fold, ids, to_arrow_schema(schema))
    return rows.repartition(*ids).sortWithinPartitions(*ids, POSITION).mapInArrow(emit, schema)


def _walk(tried: DataFrame, slices: DataFrame, keys: list[str], turn: int) -> DataFrame:
    """Per host: the exact start of every slice reached (``try`` false) and what to run next (``try`` true).

    Works on digests only: a few dozen bytes per slice, so even a host with millions of slices is small.
    From the second round on, the open slices are also tried from the state the walk stands at,
    because a detector that has stopped learning passes its state through unchanged.
    """
    known = tried.select(*keys, SLICE, START, "end_id", "_round")
    links = known.join(slices, [*keys, SLICE])
    schema = T.StructType(
        [links.schema[c] for c in keys]
        + [T.StructField(SLICE, T.LongType()), T.StructField(START, T.StringType()), T.StructField("try", T.BooleanType())]
    )

    def chain(host: tuple, host_links: list[tuple]) -> list[tuple]:
        ends = {(s, a): e for s, a, e, _ in host_links}
        latest = {s: e for s, _, e, _ in host_links}
        after = {s: n for s, _, _, n in host_links}
        order = list(after)
        out = []
        state, i = GUESSED, 0
        while i < len(order) and (order[i], state) in ends:
            state = ends[order[i], state]
            out.append((*host, after[order[i]], state, False))
            i += 1
        for j in range(i, len(order)):
            guesses = {state} if j == i else {latest[order[j - 1]]} | ({state} if turn > 1 else set())
            out.extend((*host, order[j], g, True) for g in sorted(guesses) if (order[j], g) not in ends)
        return out

    n, columns = len(keys), [*keys, SLICE, START, "end_id", "_next"]
    kinds = to_arrow_schema(schema)

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hosts follow each other in a task; the links of one are held at a time."""
        host, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[:n] != host:
                    if held:
                        out.extend(chain(host, held))
                    host, held = row[:n], []
                held.append(row[n:])
            if out:
                yield shown(out)
        if held and (out := chain(host, held)):
            yield shown(out)

    placed = links.repartition(*keys).sortWithinPartitions(*keys, SLICE, "_round")
    return placed.select(*columns).mapInArrow(emit, schema)
