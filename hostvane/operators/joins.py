"""Joins with a side that is small by nature but whose size is checked anyway."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvane.session import materialize

BROADCAST_ROWS = 200_000


def join_checked(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Join ``big`` with ``small`` (a few plain columns per key) without shuffling ``big`` when that is safe.

    ``small`` is written once and counted (``stored`` if it is read from a table already). Up to ``max_rows`` rows it is broadcast; beyond that
    the join shuffles both sides, where adaptive execution splits skewed keys.
    """
    kept = small if stored else materialize(small, "small")
    if kept.count() <= max_rows:
        kept = F.broadcast(kept)
    return big.join(kept, list(keys), how)
