"""Hyper-parameter sweeps: all trials share the passes that one training takes.

A grid runs whole or is refused; it is never cut.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostvane.operators.ranks import GROUP_ROWS, Quantile, aggregate
from hostvane.operators.training import (
    DEFAULT_COMPONENTS,
    DEFAULT_PERCENTILE,
    errors_by_components,
    fit_all_components,
)

# Limits of a sweep.
GRID_LIMIT = 100
MAX_TRIALS = 50
RANDOM_TRIALS = 10


@dataclass(frozen=True)
class Sweep:
    algorithm: str = "grid"
    n_components: tuple[int, ...] = ()
    percentile: tuple[float, ...] = ()
    max_trials: int | None = None
    seed: int | None = None

    def space(self) -> tuple[Sequence[int], Sequence[float]]:
        return self.n_components or (DEFAULT_COMPONENTS,), self.percentile or (DEFAULT_PERCENTILE,)

    def problems(self) -> list[tuple[str, str]]:
        """(field, message) for everything wrong with the request."""
        found = []
        if self.algorithm not in ("grid", "random"):
            found.append(("algorithm", "must be grid or random"))
        if self.max_trials is not None and not 1 <= self.max_trials <= MAX_TRIALS:
            found.append(("max_trials", f"must be between 1 and {MAX_TRIALS}"))
        if not self.n_components and not self.percentile:
            found.append(("search_space", "must not be empty"))
        if any(not 1 <= k <= 5 for k in self.n_components):
            found.append(("search_space.n_components", "must be between 1 and 5"))
        if any(not 50.0 <= p < 100.0 for p in self.percentile):
            found.append(("search_space.percentile", "must be at least 50 and below 100"))
        ks, ps = self.space()
        most = min(self.max_trials or GRID_LIMIT, GRID_LIMIT)
        if self.algorithm == "grid" and len(ks) * len(ps) > most:
            found.append(("search_space", f"grid must not exceed {most} combinations"))
        return found

    def trials(self) -> list[tuple[int, float]]:
        """(components, percentile) in trial order. Random draws repeat for a given seed."""
        ks, ps = self.space()
        if self.algorithm == "grid":
            return [(k, p) for k in ks for p in ps]
        draw = random.Random(self.seed)
        return [(draw.choice(ks), draw.choice(ps)) for _ in range(self.max_trials or RANDOM_TRIALS)]


def run_sweep(
    telemetry: DataFrame,
    sweep: Sweep,
    keys: Sequence[str] = ("run_id",),
    normal_only: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per group and trial: its parameters, threshold and whether it is the best.

    Moments and eigenvectors are shared by all trials; errors for every component count come
    from one walk over the rows; every percentile comes from one aggregate.
    """
    problems = sweep.problems()
    if problems:
        raise ValueError("; ".join(f"{f} {m}" for f, m in problems))
    trials = sweep.trials()
    ks = sorted({k for k, _ in trials})
    source = telemetry.where(~F.col("is_anomaly")) if normal_only else telemetry
    rows, models = fit_all_components(source, keys)
    errors = errors_by_components(rows, models, keys, ks)
    names = {(k, p): f"t{i}" for i, (k, p) in enumerate(dict.fromkeys(trials))}
    wanted = {name: Quantile(f"err_{k}", p / 100.0, nearest=True) for (k, p), name in names.items()}
    wide = aggregate(errors, keys, [], wanted, group_rows, count_in=rows)
    entries = [
        F.struct(
            F.lit(i).alias("trial_index"),
            F.lit(k).alias("n_components"),
            F.lit(float(p)).alias("percentile"),
            F.col(names[k, p]).alias("selection_metric_value"),
        )
        for i, (k, p) in enumerate(trials)
    ]
    long = wide.select(*keys, F.inline(F.array(*entries)))
    best = Window.partitionBy(*keys).orderBy("selection_metric_value", "trial_index")
    return long.withColumn("is_best", F.row_number().over(best) == 1)
