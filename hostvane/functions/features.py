"""Feature projection and preprocessing as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvane.schemas import FEATURES, NETWORK_FEATURES


def select_features(df: DataFrame, *carry: str) -> DataFrame:
    return df.select(*carry, *FEATURES)


def preprocessed(name: str, log1p_network: bool = False) -> Column:
    """Negative readings become 0; network rates are optionally put on a log scale."""
    clamped = F.greatest(F.col(name), F.lit(0.0))
    return F.log1p(clamped) if log1p_network and name in NETWORK_FEATURES else clamped


def preprocess(df: DataFrame, log1p_network: bool = False, features: Sequence[str] = FEATURES) -> DataFrame:
    return df.withColumns({f: preprocessed(f, log1p_network) for f in features})


def project_json_samples(df: DataFrame, column: str, *carry: str) -> DataFrame:
    """One row per object of a JSON array; an absent feature reads as 0.0."""
    shape = "array<struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">>"
    items = F.posexplode(F.from_json(F.col(column), shape)).alias("sample_index", "sample")
    return df.select(*carry, items).select(
        *carry, "sample_index", *[F.coalesce(F.col(f"sample.{f}"), F.lit(0.0)).alias(f) for f in FEATURES]
    )
