"""Exact order statistics that stay distributed however large a group is.

A group whose size has been checked goes through Spark's own exact aggregate. Of larger groups, the columns that
need quantiles are written once as a narrow table, and all of their ranks in all columns are narrowed together: each
pass over that table counts rows per slice of the value ranges that still hold a wanted rank, with map-side
partial counts, and keeps only those slices. Row values never gather in one task, the source is read a fixed
number of times, and the answers are exact order statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostvane.operators.joins import BROADCAST_ROWS
from hostvane.session import materialize

GROUP_ROWS = 250_000
SLICES = 16_384


@dataclass(frozen=True)
class Quantile:
    """Interpolated (``percentile_cont``) unless ``nearest``, which takes the ceil-rank row."""

    column: str
    p: float
    nearest: bool = False



def quantile_columns(quantiles: Mapping[str, Quantile]) -> tuple[list[Column], list[Column]]:
    """(aggregates, columns that pick each quantile out of them).

    Quantiles of one column share one aggregate, so its values are gathered once.
    """
    shared: dict[tuple[str, bool], list[str]] = {}
    for name, q in quantiles.items():
        shared.setdefault((q.column, q.nearest), []).append(name)
    aggregates, picks = [], {}
    for n, ((column, nearest), names) in enumerate(shared.items()):
        function = "percentile_disc" if nearest else "percentile_cont"
        points = ", ".join(f"{quantiles[name].p!r}D" for name in names)
        expression = F.expr(f"{function}(array({points})) within group (order by `{column}`)")
        aggregates.append(expression.alias(f"_q{n}"))
        picks |= {name: F.col(f"_q{n}")[i].alias(name) for i, name in enumerate(names)}
    return aggregates, [picks[name] for name in quantiles]


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in the largest group, and rows in all; counted with partial aggregation."""
    per_group = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = per_group.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return (row["top"] or 0, row["total"] or 0)


def hot_groups(df: DataFrame, keys: Sequence[str], group_rows: int) -> tuple[DataFrame | None, bool]:
    """(keys of groups above ``group_rows`` as a written table, or None; whether there are other groups)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(sizes.where(F.col("_n") > group_rows).select(*keys), "hot")
    n_hot = hot.count()
    return (hot if n_hot else None), n_hot < sizes.count()


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    plain: Sequence[Column],
    quantiles: Mapping[str, Quantile],
    group_rows: int = GROUP_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """``groupBy(keys)`` with ordinary aggregates plus exact quantiles named by ``quantiles``.

    ``count_in`` may name a frame with the same rows per group that is cheaper to count. A quantile of a column without
    values is NULL, in groups of any size.
    """
    if not quantiles:
        return df.groupBy(*keys).agg(*plain)
    if not keys:
        raise ValueError("quantiles need at least one grouping column")
    counted = df if count_in is None else count_in
    if group_sizes(counted, keys)[0] <= group_rows:
        return _in_groups(df, keys, plain, quantiles)
    hot, others = hot_groups(counted, keys, group_rows)
    hot_df = keyed_join(df, hot, keys, "left_semi") if others else df
    hot_part = hot_df.groupBy(*keys).agg(*plain) if plain else hot
    hot_part = keyed_join(hot_part, _hot_quantiles(hot_df, keys, quantiles), keys, "left")
    if not others:
        return hot_part
    result = _in_groups(keyed_join(df, hot, keys, "left_anti"), keys, plain, quantiles)
    return result.unionByName(hot_part.select(*result.columns))


def _in_groups(df: DataFrame, keys: Sequence[str], plain: Sequence[Column], quantiles: Mapping[str, Quantile]) -> DataFrame:
    aggregates, picks = quantile_columns(quantiles)
    grouped = df.groupBy(*keys).agg(*plain, *aggregates)
    return grouped.select(*[c for c in grouped.columns if not c.startswith("_q")], *picks)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on ``keys``. ``right`` is a written table or cheap to count; it is broadcast only up to a limit."""
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_k_{k}"])
    joined = left.join(_small(renamed), condition, how)
    return joined.drop(*[f"_k_{k}" for k in keys])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hot_quantiles(df: DataFrame, keys: Sequence[str], quantiles: Mapping[str, Quantile]) -> DataFrame:
    """One row per group: keys and all ``quantiles``, of whatever columns."""
    columns = list(dict.fromkeys(q.column for q in quantiles.values()))
    narrow = materialize(df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]), "values")
    pairs = F.array(*[F.struct(F.lit(i).alias("_col"), F.col(f"_c{i}").alias("_v")) for i in range(len(columns))])
    rows = narrow.select(*keys, F.inline(pairs)).where(F.col("_v").isNotNull())
    inner = [*keys, "_col"]
    bounds = rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    n = F.col("_n")
    wanted = []
    for name, q in quantiles.items():
        if q.nearest:
            low = F.greatest(F.ceil(n * F.lit(q.p)) - 1, F.lit(0))
            high, weight = low, F.lit(0.0)
        else:
            position = (n - 1) * F.lit(q.p)
            low, high = F.floor(position), F.ceil(position)
            weight = position - F.floor(position)
        for side, rank in (("lo", low), ("hi", high)):
            wanted.append(
                F.struct(
                    F.lit(columns.index(q.column)).alias("_of"),
                    F.lit(f"{name}:{side}").alias("_tag"),
                    F.least(rank, n - 1).cast("long").alias("_rank"),
                    weight.cast("double").alias("_w"),
                )
            )
    own = F.filter(F.array(*wanted), lambda s: s["_of"] == F.col("_col"))
    found = _narrowed(rows, bounds.select(*inner, "_lo", "_hi", F.inline(own)).drop("_of"), inner)
    aggs = []
    for name in quantiles:
        lo = F.max(F.when(F.col("_tag") == f"{name}:lo", F.col("_value")))
        hi = F.max(F.when(F.col("_tag") == f"{name}:hi", F.col("_value")))
        w = F.max(F.when(F.col("_tag") == f"{name}:lo", F.col("_w")))
        aggs.append((lo + (hi - lo) * w).alias(name))
    return materialize(found.groupBy(*keys).agg(*aggs), "quantiles")


def values_at_ranks(rows: DataFrame, targets: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``targets`` (keys, _tag, _rank zero-based ascending, ...) with the value at each rank as ``_value``."""
    values = rows.select(*keys, F.col(column).alias("_v")).where(F.col("_v").isNotNull())
    bounds = materialize(values.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "bounds")
    return _narrowed(values, keyed_join(targets, bounds, keys, "inner"), keys)


def _narrowed(values: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Follow every target's range (_lo, _hi) down to the one value at its rank. One pass over ``values`` per round."""
    open_ranks = materialize(targets, "ranks")
    closed: list[DataFrame] = []
    while True:
        closed.append(
            open_ranks.where(F.col("_lo") == F.col("_hi"))
            .withColumnRenamed("_lo", "_value")
            .drop("_hi")
        )
        left = open_ranks.where(F.col("_lo") < F.col("_hi"))
        if left.isEmpty():
            break
        open_ranks = materialize(_narrow(values, left, keys), "ranks")
    result = closed[0]
    for part in closed[1:]:
        result = result.unionByName(part)
    return result


def _narrow(values: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace every target's range by the slice of it that holds the rank.

    The two ends of a range always fall in different slices, so every pass shrinks it.
    """
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    ranges = targets.select(*keys, "_lo", "_hi").distinct()
    renamed = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_lo", "_hi")
    condition = (v >= lo) & (v <= hi)
    for k in keys:
        condition = condition & values[k].eqNullSafe(renamed[f"_k_{k}"])
    inside = values.join(_small(renamed), condition).drop(*[f"_k_{k}" for k in keys])
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    infinite = (lo == float("-inf")) | (hi >= float("inf"))
    part = (
        F.when(v == lo, 0)
        .when(v == hi, SLICES - 1)
        .when(infinite, 1)
        .otherwise(F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("int"))
    )
    counts = inside.groupBy(*keys, "_lo", "_hi", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
    )
    running = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_part")
    counts = counts.withColumn(
        "_before", F.sum("_c").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    )
    counts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_lo").alias("_r_lo"), F.col("_hi").alias("_r_hi"), "_before", "_c", "_from", "_to",
    )
    held = (
        (F.col("_lo") == F.col("_r_lo"))
        & (F.col("_hi") == F.col("_r_hi"))
        & (F.col("_rank") >= F.col("_before"))
        & (F.col("_rank") < F.col("_before") + F.col("_c"))
    )
    for k in keys:
        held = held & targets[k].eqNullSafe(counts[f"_k_{k}"])
    carried = [c for c in targets.columns if c not in ("_rank", "_lo", "_hi")]
    return targets.join(counts, held).select(
        *[targets[c] for c in carried],
        (F.col("_rank") - F.col("_before")).alias("_rank"),
        F.col("_from").alias("_lo"),
        F.col("_to").alias("_hi"),
    )
