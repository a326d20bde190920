"""The PCA reconstruction model, and scoring as generated column arithmetic.

Scoring never leaves the JVM: each step is a projection of plain double arithmetic, so the
whole model stays inside one code-generated stage and no row visits Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvane.functions.features import preprocess
from hostvane.schemas import FEATURES

DIM = len(FEATURES)


@dataclass(frozen=True)
class PcaModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained_variance: tuple[float, ...]
    pca_mean: tuple[float, ...]
    threshold: float
    preprocessed: bool = False
    log1p_network: bool = False
    rows_used: int | None = None

    def __post_init__(self) -> None:
        if len(self.mean) != DIM or len(self.scale) != DIM or len(self.pca_mean) != DIM:
            raise ValueError(f"model preprocessing must have {DIM} entries")
        if not self.components:
            raise ValueError("model has no components")
        if any(len(c) != DIM for c in self.components):
            raise ValueError(f"model components must have {DIM} entries")

    @property
    def n_components(self) -> int:
        return len(self.components)


# The default model, needed to reproduce published scores.
DEFAULT_MODEL = PcaModel(
    mean=(
        39.801229605078134,
        31.839078082509555,
        29.982530855870394,
        50.49438063012798,
        25.290003895368887,
    ),
    scale=(
        9.993545219674711,
        9.314685295634089,
        1.9988834273130236,
        10.054830026749208,
        5.411170447313796,
    ),
    components=(
        (
            -0.09024539264578475,
            -0.08965648827251314,
            0.02016298585223052,
            0.7013224321376184,
            0.7011118194688686,
        ),
        (
            0.701245191758247,
            0.7012060340508458,
            -0.01712327471729847,
            0.08964858731384963,
            0.0907480198252883,
        ),
        (
            0.007666558206639367,
            0.01999128181559161,
            0.9995934087636162,
            -0.008297036828160334,
            -0.016904108164585124,
        ),
    ),
    explained_variance=(1.9326945754671996, 1.8387589298229015, 0.9996736317586087),
    pca_mean=(
        -1.2921130831955452e-14,
        2.0386359267376976e-15,
        -7.251863554103011e-14,
        1.2742873423121637e-14,
        -8.809841745005543e-15,
    ),
    threshold=1.1971291001486588,
)


@dataclass(frozen=True)
class Coefficients:
    """The numbers of a model as SQL text: literals for one model, or columns of a joined model row."""

    mean: Sequence[str]
    scale: Sequence[str]
    pca_mean: Sequence[str]
    components: Sequence[Sequence[str]]

    @staticmethod
    def literal(model: PcaModel) -> Coefficients:
        row = lambda values: [number(v) for v in values]
        return Coefficients(row(model.mean), row(model.scale), row(model.pca_mean), [row(c) for c in model.components])

    @staticmethod
    def joined(n_components: int) -> Coefficients:
        """The plain columns that ``flat_model`` makes."""
        named = lambda prefix: [f"{prefix}{i}" for i in range(DIM)]
        return Coefficients(
            named("_mean"), named("_scale"), named("_center"), [named(f"_c{j}_") for j in range(n_components)]
        )


def number(value: float) -> str:
    return f"({float(value)!r}D)"


def flat_model(models: DataFrame, column: str, keys: Sequence[str], n_components: int) -> DataFrame:
    """A model struct as one plain column per number, so joined rows read doubles, not nested arrays."""
    numbers = {"_mean": "preprocessing.mean", "_scale": "preprocessing.scale", "_center": "model.mean"}
    flat = [f"{column}.{path}[{i}] AS {name}{i}" for name, path in numbers.items() for i in range(DIM)]
    axes = f"{column}.model.components"
    flat += [f"{axes}[{j}][{i}] AS _c{j}_{i}" for j in range(n_components) for i in range(DIM)]
    return models.selectExpr(*keys, *flat)


def centered(c: Coefficients) -> list[str]:
    """Standardized and centered features as ``_x0`` to ``_x4``."""
    return [f"({f} - {c.mean[i]}) / {c.scale[i]} - {c.pca_mean[i]} AS _x{i}" for i, f in enumerate(FEATURES)]


def projections(c: Coefficients) -> list[str]:
    """Coordinates on each component as ``_p0`` and so on."""
    return [
        " + ".join(f"{axis[i]} * _x{i}" for i in range(DIM)) + f" AS _p{j}" for j, axis in enumerate(c.components)
    ]


def residuals_of(model: PcaModel) -> list[str]:
    """What the components leave unexplained, per feature, as ``_r0`` to ``_r4``.

    Projecting and reconstructing is one linear map, so it is folded into a 5 x 5 matrix here:
    one short expression per feature.
    """
    axes = np.array(model.components)
    left = np.eye(DIM) - axes.T @ axes
    return [
        " + ".join(f"{number(left[i, j])} * _x{j}" for j in range(DIM)) + f" AS _r{i}" for i in range(DIM)
    ]


RESIDUAL_NORM = "sqrt(" + " + ".join(f"_r{i} * _r{i}" for i in range(DIM)) + ")"


def fenced(df: DataFrame, keep: Sequence[str], computed: dict[str, Column]) -> DataFrame:
    """``keep`` columns plus ``computed`` ones, each evaluated once per row.

    A later filter on a computed column would otherwise be rewritten over the inputs and repeat
    the whole arithmetic per condition. Filters on ``keep`` columns still reach the scan.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))))


def score_rows(df: DataFrame, model: PcaModel, residuals: bool = False) -> DataFrame:
    """``df`` plus ``reconstruction_error`` and ``predicted_is_anomaly``.

    With ``residuals``, also the residual vector and the feature that contributes most.
    """
    kept = [f"`{c}`" for c in df.columns]
    steps = df.selectExpr(*kept, *centered(Coefficients.literal(model))).selectExpr(*kept, *residuals_of(model))
    steps = steps.selectExpr("*", f"{RESIDUAL_NORM} AS _error")
    computed = {
        "reconstruction_error": F.col("_error"),
        "predicted_is_anomaly": F.expr(f"_error > {number(model.threshold)}"),
    }
    if residuals:
        # the first feature wins a tie, hence the descending number
        sized = ", ".join(
            f"struct(abs(_r{i}) AS size, {DIM - i} AS first, '{f}' AS name)" for i, f in enumerate(FEATURES)
        )
        computed["residuals"] = F.expr("array(" + ", ".join(f"_r{i}" for i in range(DIM)) + ")")
        computed["top_contributor"] = F.expr(f"array_max(array({sized})).name")
    return fenced(steps, df.columns, computed)


def score(df: DataFrame, model: PcaModel, residuals: bool = False) -> DataFrame:
    """Score rows that carry the five features. The model's own preprocessing choice is applied."""
    if not model.preprocessed:
        return score_rows(df, model, residuals)
    raw = {f"_raw_{f}": F.col(f) for f in FEATURES}
    shaped = preprocess(df.withColumns(raw), model.log1p_network)
    scored = score_rows(shaped, model, residuals)
    return scored.withColumns({f: F.col(f"_raw_{f}") for f in FEATURES}).drop(*raw)


def fixed_decimals(value: Column, digits: int) -> Column:
    """Decimal text rounded from the exact binary value, ties to even, without group separators."""
    return F.translate(F.format_number(value, digits), ",", "")


def six_digits(value: Column) -> Column:
    """Text of a non-negative number with six significant digits, as ``%g`` writes it."""
    text = F.regexp_replace(F.format_string("%.5e", value), r"\.?0+e", "e")
    for magnitude in range(5, -5, -1):
        plain = fixed_decimals(value, 5 - magnitude)
        if magnitude < 5:
            plain = F.regexp_replace(plain, r"\.?0+$", "")
        in_range = (value < F.lit(float(f"9.999995e{magnitude}"))) & (value >= F.lit(float(f"9.999995e{magnitude - 1}")))
        text = F.when(in_range, plain).otherwise(text)
    return F.when(value == 0, "0").otherwise(text)


def score_details(threshold: float, error: str = "reconstruction_error") -> Column:
    """Text for anomalous rows, numbers to six significant digits; NULL otherwise."""
    value = F.col(error)
    message = F.concat(F.lit("PCA_RECON_ERR="), six_digits(value), F.lit(f" > {threshold:g}"))
    return F.when(value > F.lit(threshold), message)


def dataset_scores(telemetry: DataFrame, model: PcaModel, model_run_id: str) -> DataFrame:
    """The score table of a dataset: one narrow projection of its rows."""
    return score(telemetry.select("run_id", "record_id", *FEATURES), model).select(
        F.col("run_id").alias("dataset_id"),
        F.lit(model_run_id).alias("model_run_id"),
        "record_id",
        "reconstruction_error",
        "predicted_is_anomaly",
    )
