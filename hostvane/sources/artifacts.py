"""Model artifacts as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvane.functions.pca import PcaModel
from hostvane.operators.training import ARTIFACT_TYPE, ARTIFACT_VERSION, model_from_row
from hostvane.schemas import FEATURES, MODEL_SCHEMA


def model_row(spark: SparkSession, model: PcaModel) -> DataFrame:
    document = {
        "meta": {
            "version": ARTIFACT_VERSION,
            "type": ARTIFACT_TYPE,
            "features": list(FEATURES),
            "preprocessed": model.preprocessed,
            "log1p_network": model.log1p_network,
            "rows_used": model.rows_used,
        },
        "preprocessing": {"mean": list(model.mean), "scale": list(model.scale)},
        "model": {
            "components": [list(c) for c in model.components],
            "explained_variance": list(model.explained_variance),
            "mean": list(model.pca_mean),
            "n_components": model.n_components,
        },
        "thresholds": {"reconstruction_error": model.threshold},
    }
    parsed = F.from_json(F.lit(json.dumps(document)), MODEL_SCHEMA)
    return spark.range(1).select(parsed.alias("m")).select("m.*")


def write_model(spark: SparkSession, model: PcaModel, path: str) -> None:
    model_row(spark, model).coalesce(1).write.mode("overwrite").json(path)


def write_models(models: DataFrame, path: str) -> None:
    """Many trained models (keys and struct ``model``), one document per line."""
    models.write.mode("overwrite").json(path)


def read_model(spark: SparkSession, path: str) -> PcaModel:
    """The artifact at ``path``. Anything but five features and at least one component is an error."""
    row = spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path).first()
    if row is None:
        raise ValueError(f"no model artifact in {path}")
    for part in ("preprocessing", "model", "thresholds"):
        if row[part] is None:
            raise ValueError(f"model artifact in {path} has no {part}")
    missing_meta = {**row.asDict(), "meta": row["meta"] or {"preprocessed": False, "log1p_network": False, "rows_used": None}}
    return model_from_row(missing_meta)
