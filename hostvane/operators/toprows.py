"""First rows of a group in an order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARES = 64
RANK = "_rank"


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of every group with their place in ``_rank``, from 1. ``order`` must be total.

    Ranks are first taken within shares of a group, so no task sees a whole large group: a row among the
    first k of its group is among the first k of its share.
    """
    share = F.pmod(F.xxhash64(*df.columns), F.lit(SHARES))
    in_share = Window.partitionBy(*keys, "_share").orderBy(*order)
    some = df.withColumn("_share", share).withColumn(RANK, F.row_number().over(in_share)).where(F.col(RANK) <= k)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return some.drop("_share").withColumn(RANK, F.row_number().over(in_group)).where(F.col(RANK) <= k)
