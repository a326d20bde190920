"""Position of every row in its host's time order, and slices of bounded length.

Detectors depend on earlier rows of the same host, and one host may hold a large part of
all rows. ``numbered`` gives each row its position without ever putting a large host in one
task; ``slice`` = position div length then bounds what any later task has to hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostvane.operators.joins import join_checked
from hostvane.operators.ranks import group_sizes
from hostvane.schemas import HOST_KEYS, TIME_ORDER
from hostvane.session import materialize

SLICE_ROWS = 1_000_000
RANGE_ROWS = 100_000  # rows that a task numbers at least, however short the slices are
POSITION = "_pos"
SLICE = "_slice"


@dataclass(frozen=True)
class HostRows:
    """Rows with their position and slice. ``split`` tells whether any host has a second slice;
    if none has, all rows of a host are in the same task."""

    rows: DataFrame
    keys: tuple[str, ...]
    slice_rows: int
    split: bool


def numbered(
    df: DataFrame,
    keys: Sequence[str] = HOST_KEYS,
    order: Sequence[str] = TIME_ORDER,
    slice_rows: int = SLICE_ROWS,
) -> HostRows:
    """Add ``_pos`` (from 0, per host, in ``order``) and ``_slice``. ``order`` must be total."""
    largest, total = group_sizes(df, keys)
    if largest <= slice_rows:
        return _in_one_slice(df, keys, order, slice_rows)
    return _in_slices(df, keys, order, slice_rows, total)


def for_hosts(
    df: DataFrame,
    build: Callable[[HostRows], DataFrame],
    slice_rows: int = SLICE_ROWS,
    count_in: DataFrame | None = None,
    keys: Sequence[str] = HOST_KEYS,
    order: Sequence[str] = TIME_ORDER,
) -> DataFrame:
    """``build`` over numbered rows: hosts that fit one task as whole hosts, the others as slices.

    ``count_in`` may name a frame with the same rows per host that is cheaper to count.
    """
    counted = df if count_in is None else count_in
    if group_sizes(counted, keys)[0] <= slice_rows:
        return build(_in_one_slice(df, keys, order, slice_rows))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    large = materialize(sizes, "large")
    rows_in_large = large.agg(F.sum("_n")).first()[0]
    hosts = large.select(*keys)
    small_df = join_checked(df, hosts, keys, "left_anti", stored=True)
    large_df = join_checked(df, hosts, keys, "left_semi", stored=True)
    whole = build(_in_one_slice(small_df, keys, order, slice_rows))
    return whole.unionByName(build(_in_slices(large_df, keys, order, slice_rows, rows_in_large)))


def _in_one_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int) -> HostRows:
    in_time = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn(POSITION, (F.row_number().over(in_time) - 1).cast("long")).withColumn(
        SLICE, F.lit(0).cast("long")
    )
    return HostRows(rows, tuple(keys), slice_rows, False)


def _in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int, total: int) -> HostRows:
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = number_by_ranges(df, keys, order, max(at_least, -(-total // max(slice_rows, RANGE_ROWS))))
    rows = rows.withColumn(SLICE, F.floor(F.col(POSITION) / F.lit(slice_rows)).cast("long"))
    return HostRows(rows, tuple(keys), slice_rows, True)


def number_by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ranges: int) -> DataFrame:
    """Range-partition by (keys, order), so a large host spreads over many tasks; number rows inside
    each task; then add, per host, the rows it has in earlier tasks.

    The sorted rows are written once. Range bounds come from a sample, so computing them again
    could place rows differently; the written table cannot change under a retry.
    """
    spread = (
        df.repartitionByRange(ranges, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    written = materialize(spread, "ordered")
    # The id is the task number above 33 bits of row number within the task.
    task = F.shiftright("_mid", 33)
    parts = written.groupBy(*keys, task.alias("_task")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *keys, "_task", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    rows = join_checked(written.withColumn("_task", task), starts, [*keys, "_task"])
    return rows.withColumn(POSITION, F.col("_mid") + F.col("_shift")).drop("_mid", "_task", "_shift")


def with_lead_in(seq: HostRows, lead: int) -> DataFrame:
    """Rows plus, for every slice after a host's first, copies of the ``lead`` rows before it.

    Copies carry the slice they lead into and ``_lead`` = true. A window over (keys, slice) then
    sees what it needs without crossing slices. ``lead`` may not exceed a slice.
    """
    rows = seq.rows
    if not seq.split:
        return rows.withColumn("_lead", F.lit(False))
    if lead > seq.slice_rows:
        raise ValueError(f"slices of {seq.slice_rows} rows cannot carry a lead-in of {lead}")
    tail = F.pmod(F.col(POSITION), F.lit(seq.slice_rows)) >= seq.slice_rows - lead
    slices = F.when(tail, F.array(F.col(SLICE), F.col(SLICE) + 1)).otherwise(F.array(F.col(SLICE)))
    others = [c for c in rows.columns if c != SLICE]
    return rows.select(*others, F.col(SLICE).alias("_own"), F.explode(slices).alias(SLICE)).select(
        *others, SLICE, (F.col(SLICE) != F.col("_own")).alias("_lead")
    )
