"""PCA training: grouped moments, one small eigen solve per model, one pass for thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostvane.functions.features import preprocess
from hostvane.functions.pca import (
    DIM,
    RESIDUAL_NORM,
    Coefficients,
    PcaModel,
    centered,
    fenced,
    flat_model,
    projections,
)
from hostvane.operators.joins import join_checked
from hostvane.operators.ranks import GROUP_ROWS, Quantile, aggregate
from hostvane.schemas import FEATURES, MODEL_SCHEMA
from hostvane.session import materialize

# What an artifact says about itself.
ARTIFACT_VERSION = "v1"
ARTIFACT_TYPE = "pca_reconstruction"
DEFAULT_COMPONENTS = 3
DEFAULT_PERCENTILE = 99.5

PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def check_components(k: int) -> int:
    if not 1 <= k <= DIM:
        raise ValueError(f"number of components must be between 1 and {DIM}, got {k}")
    return k


def moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, means and sample covariances per group, in one pass with partial aggregation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"mean_{f}") for f in FEATURES],
        *[F.covar_samp(FEATURES[i], FEATURES[j]).alias(f"cov_{i}_{j}") for i, j in PAIRS],
    )


def solve(mean: np.ndarray, cov: np.ndarray) -> dict:
    """Scale, components (rows, largest variance first) and variances of one covariance matrix."""
    scale = np.sqrt(np.diag(cov))
    scale = np.where(scale == 0.0, 1.0, scale)
    variances, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-variances, kind="stable")
    components = vectors[:, order].T.copy()
    for row in components:
        if row[np.argmax(np.abs(row))] < 0.0:
            row *= -1.0
    return {"mean": mean, "scale": scale, "components": components, "variances": variances[order]}


def _model_rows(keys: Sequence[str], options: dict):
    """Turns moment rows into model rows; one row per model, so a task holds only small matrices."""

    def to_models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, r in batch.iterrows():
                cov = np.zeros((DIM, DIM))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"cov_{i}_{j}"]
                fit = solve(np.array([r[f"mean_{f}"] for f in FEATURES], dtype=float), cov)
                model = {
                    "meta": {
                        "version": ARTIFACT_VERSION,
                        "type": ARTIFACT_TYPE,
                        "features": list(FEATURES),
                        "preprocessed": options["preprocessed"],
                        "log1p_network": options["log1p_network"],
                        "rows_used": int(r["n"]),
                    },
                    "preprocessing": {"mean": fit["mean"].tolist(), "scale": fit["scale"].tolist()},
                    "model": {
                        "components": fit["components"].tolist(),
                        "explained_variance": fit["variances"].tolist(),
                        "mean": [0.0] * DIM,
                        "n_components": DIM,
                    },
                    "thresholds": {"reconstruction_error": None},
                }
                rows.append({**{k: r[k] for k in keys}, "fit": model})
            yield pd.DataFrame(rows, columns=[*keys, "fit"])

    return to_models


def fit_all_components(
    df: DataFrame, keys: Sequence[str], preprocessed: bool = False, log1p_network: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(training rows, one full-rank model per group as struct ``fit``).

    The mean of the standardized rows is 0 by construction, so no pass is spent on it.
    Groups with fewer than two rows have no covariance and give no model.
    """
    rows = df.select(*keys, *FEATURES)
    if preprocessed:
        rows = preprocess(rows, log1p_network)
    return rows, models_of(moments(rows, keys), keys, preprocessed, log1p_network)


def models_of(found: DataFrame, keys: Sequence[str], preprocessed: bool = False, log1p_network: bool = False) -> DataFrame:
    """(keys, ``fit``): one full-rank model per row of ``moments``, however these were found."""
    schema = T.StructType([found.schema[k] for k in keys] + [T.StructField("fit", MODEL_SCHEMA)])
    options = {"preprocessed": preprocessed, "log1p_network": log1p_network}
    return materialize(found.where(F.col("n") >= 2).mapInPandas(_model_rows(keys, options), schema), "models")


def errors_by_components(rows: DataFrame, models: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """``err_k`` for each k in ``ks``: components are peeled off one after the other, so one
    walk gives every k, and small errors do not suffer from subtracting large squares."""
    last = max(ks)
    c = Coefficients.joined(last)
    joined = join_checked(rows, flat_model(models, "fit", keys, last), keys, stored=True)
    axes = [name for axis in c.components for name in axis]
    found = [f"_p{j}" for j in range(last)]
    step = joined.selectExpr(*keys, *axes, *centered(c)).selectExpr(
        *keys, *axes, *projections(c), *[f"_x{i} AS _r{i}" for i in range(DIM)]
    )
    errors: list[str] = []
    for j in range(last):
        peeled = [f"_r{i} - {c.components[j][i]} * _p{j} AS _r{i}" for i in range(DIM)]
        step = step.selectExpr(*keys, *axes, *found, *errors, *peeled)
        if j + 1 in ks:
            step = step.selectExpr("*", f"{RESIDUAL_NORM} AS err_{j + 1}")
            errors.append(f"err_{j + 1}")
    return fenced(step, keys, {e: F.col(e) for e in errors})


def truncated(fit: str, k: int, threshold: Column) -> Column:
    """The full-rank model struct cut to its first k components, with its threshold."""
    head = F.col(f"{fit}.model")
    return F.struct(
        F.col(f"{fit}.meta").alias("meta"),
        F.col(f"{fit}.preprocessing").alias("preprocessing"),
        F.struct(
            F.slice(head["components"], 1, k).alias("components"),
            F.slice(head["explained_variance"], 1, k).alias("explained_variance"),
            head["mean"].alias("mean"),
            F.lit(k).alias("n_components"),
        ).alias("model"),
        F.struct(threshold.alias("reconstruction_error")).alias("thresholds"),
    )


def train_models(
    telemetry: DataFrame,
    k: int = DEFAULT_COMPONENTS,
    percentile: float = DEFAULT_PERCENTILE,
    keys: Sequence[str] = ("run_id",),
    normal_only: bool = False,
    preprocessed: bool = False,
    log1p_network: bool = False,
    group_rows: int = GROUP_ROWS,
    known: DataFrame | None = None,
) -> DataFrame:
    """One model per group: keys and struct ``model``. All groups train in the same two passes.

    ``known`` moments of exactly these rows, such as ``rollups.merged_moments``, save the first pass.
    """
    check_components(k)
    if not 0.0 <= percentile <= 100.0:
        raise ValueError("percentile must be between 0 and 100")
    source = telemetry.where(~F.col("is_anomaly")) if normal_only else telemetry
    if known is None:
        rows, models = fit_all_components(source, keys, preprocessed, log1p_network)
    else:
        rows, models = source.select(*keys, *FEATURES), models_of(known, keys, preprocessed, log1p_network)
        rows = preprocess(rows, log1p_network) if preprocessed else rows
    errors = errors_by_components(rows, models, keys, [k])
    wanted = {"threshold": Quantile(f"err_{k}", percentile / 100.0, nearest=True)}
    thresholds = aggregate(errors, keys, [], wanted, group_rows, count_in=rows)
    return models.join(thresholds, list(keys)).select(
        *keys, truncated("fit", k, F.col("threshold")).alias("model")
    )


def train(df: DataFrame, k: int = DEFAULT_COMPONENTS, percentile: float = DEFAULT_PERCENTILE, **options) -> PcaModel:
    """One model over all of ``df``, as a value on the driver."""
    one = df.withColumn("_dataset", F.lit("all"))
    found = train_models(one, k, percentile, ["_dataset"], **options).select("model.*").first()
    if found is None:
        raise ValueError("not enough rows to train on")
    return model_from_row(found)


def model_from_row(row) -> PcaModel:
    return PcaModel(
        mean=tuple(row["preprocessing"]["mean"]),
        scale=tuple(row["preprocessing"]["scale"]),
        components=tuple(tuple(c) for c in row["model"]["components"] or ()),
        explained_variance=tuple(row["model"]["explained_variance"]),
        pca_mean=tuple(row["model"]["mean"]),
        threshold=row["thresholds"]["reconstruction_error"],
        preprocessed=bool(row["meta"]["preprocessed"]),
        log1p_network=bool(row["meta"]["log1p_network"]),
        rows_used=row["meta"]["rows_used"],
    )
