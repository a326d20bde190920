"""Queries that score telemetry, train models and evaluate scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hostvane.functions.features import project_json_samples
from hostvane.functions.pca import DEFAULT_MODEL, dataset_scores, score, score_details
from hostvane.operators import lifecycle, scores as score_ops, training
from hostvane.operators.ranks import Quantile, aggregate
from hostvane.operators.runs import latest_per
from hostvane.operators.tuning import Sweep, run_sweep
from hostvane.plans.dataset import T
from hostvane.plans.registry import CHECKS, HOT_ROWS, query, rounded, with_ctes
from hostvane.plans.tables import GENERATION_RUNS_SQL, SCORE_HISTORY_SQL, generation_runs, score_history, telemetry
from hostvane.schemas import FEATURES
from hostvane.session import scratch_path
from hostvane.sources.artifacts import read_model, write_model
from hostvane.sources.results import read_scores, write_scores

MODEL_ID = "pca-default"
M = DEFAULT_MODEL


def scoring_sql(source: str, prefix: str = "") -> str:
    """CTEs ``scored``: the model's arithmetic spelled out with its numbers."""
    num = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    x = ", ".join(
        f"({f} - {num(M.mean[i])}) / {num(M.scale[i])} - {num(M.pca_mean[i])} AS x{i}" for i, f in enumerate(FEATURES)
    )
    p = ", ".join(
        " + ".join(f"{num(v)} * x{i}" for i, v in enumerate(row)) + f" AS p{j}" for j, row in enumerate(M.components)
    )
    r = ", ".join(
        f"x{i} - (" + " + ".join(f"{num(row[i])} * p{j}" for j, row in enumerate(M.components)) + f") AS r{i}"
        for i in range(5)
    )
    err = "sqrt(" + " + ".join(f"r{i} * r{i}" for i in range(5)) + ")"
    return f"""
    {prefix}s1 AS (SELECT *, {x} FROM {source}),
    {prefix}s2 AS (SELECT *, {p} FROM {prefix}s1),
    {prefix}s3 AS (SELECT *, {r} FROM {prefix}s2),
    {prefix}scored AS (
      SELECT *, {err} AS reconstruction_error, {err} > {num(M.threshold)} AS predicted_is_anomaly,
             run_id AS dataset_id, '{MODEL_ID}' AS model_run_id FROM {prefix}s3)"""


SCORED = scoring_sql("telemetry")


def sql(select: str, *ctes: str) -> str:
    return with_ctes(T, SCORED, *ctes, select=select)


def scored(spark, sf_dir):
    return dataset_scores(telemetry(spark, sf_dir), M, MODEL_ID)


@query(
    "pca_score",
    sql("""
    SELECT dataset_id, model_run_id, record_id, round(reconstruction_error, 6) AS reconstruction_error,
           predicted_is_anomaly FROM scored"""),
)
def pca_score(spark, sf_dir):
    return rounded(scored(spark, sf_dir))


@query(
    "pca_residuals",
    sql("""
    SELECT record_id, round(reconstruction_error, 6) AS reconstruction_error,
           round(r0, 6) AS residual_0, round(r1, 6) AS residual_1, round(r2, 6) AS residual_2,
           round(r3, 6) AS residual_3, round(r4, 6) AS residual_4,
           CASE greatest(abs(r0), abs(r1), abs(r2), abs(r3), abs(r4))
             WHEN abs(r0) THEN 'cpu_usage' WHEN abs(r1) THEN 'memory_usage' WHEN abs(r2) THEN 'disk_utilization'
             WHEN abs(r3) THEN 'network_rx_rate' ELSE 'network_tx_rate' END AS top_contributor,
           CASE WHEN predicted_is_anomaly
                THEN 'PCA_RECON_ERR=' || format('{:g}', reconstruction_error) || ' > 1.19713' END AS details
    FROM scored"""),
)
def pca_residuals(spark, sf_dir):
    rows = score(telemetry(spark, sf_dir), M, residuals=True)
    return rounded(
        rows.select(
            "record_id",
            "reconstruction_error",
            *[F.col("residuals")[i].alias(f"residual_{i}") for i in range(5)],
            "top_contributor",
            score_details(M.threshold).alias("details"),
        )
    )


JSON_SAMPLES_SQL = """
samples AS (
  SELECT run_id, record_id, 0 AS sample_index, cpu_usage, 0.0e0 AS memory_usage, disk_utilization,
         network_rx_rate, 0.0e0 AS network_tx_rate FROM telemetry
  UNION ALL
  SELECT run_id, record_id, 1, 0.0e0, memory_usage, 0.0e0, network_rx_rate, network_tx_rate FROM telemetry)
"""


@query(
    "json_samples_scored",
    with_ctes(
        T,
        JSON_SAMPLES_SQL,
        scoring_sql("samples"),
        select="""
    SELECT record_id, count(*) AS samples, count_if(predicted_is_anomaly) AS anomaly_count,
           round(max(reconstruction_error), 6) AS worst_score
    FROM scored GROUP BY 1""",
    ),
)
def json_samples_scored(spark, sf_dir):
    """Each record becomes a request with two samples, each missing some features."""
    first = F.struct("cpu_usage", "disk_utilization", "network_rx_rate")
    second = F.struct("memory_usage", "network_rx_rate", "network_tx_rate")
    body = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]"))
    requests = telemetry(spark, sf_dir).select("record_id", body.alias("samples"))
    rows = score(project_json_samples(requests, "samples", "record_id"), M)
    return rounded(
        rows.groupBy("record_id").agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_if("predicted_is_anomaly").alias("anomaly_count"),
            F.max("reconstruction_error").alias("worst_score"),
        )
    )


@query(
    "pca_stats",
    sql(f"""
    SELECT run_id, count(*) AS n, {', '.join(f'round(avg({f}), 6) AS mean_{f}' for f in FEATURES)},
           {', '.join(f'round(covar_samp({FEATURES[i]}, {FEATURES[j]}), 6) AS cov_{i}_{j}' for i, j in training.PAIRS)}
    FROM telemetry GROUP BY 1"""),
)
def pca_stats(spark, sf_dir):
    return rounded(training.moments(telemetry(spark, sf_dir), ["run_id"]))


@query(
    "pca_threshold",
    sql("""
    SELECT dataset_id, round(quantile_disc(reconstruction_error, 0.995), 6) AS p99_5,
           round(quantile_disc(reconstruction_error, 0.9), 6) AS p90 FROM scored GROUP BY 1"""),
)
def pca_threshold(spark, sf_dir):
    error = "reconstruction_error"
    wanted = {"p99_5": Quantile(error, 0.995, nearest=True), "p90": Quantile(error, 0.9, nearest=True)}
    return rounded(aggregate(scored(spark, sf_dir), ["dataset_id"], [], wanted))


CELLS = training.PAIRS  # upper triangle of the 5 x 5 matrix


def cell(name: str, a: int, b: int) -> str:
    return f"{name}{min(a, b)}{max(a, b)}"


def training_sql(ks: int) -> tuple[str, ...]:
    """CTEs ``errors`` (run_id, err_1 ...) and ``axes`` (per run, variances l_j and components v_j_i).

    The leading component comes from squaring the correlation matrix until only its direction is left;
    the next one from the matrix without it.
    """
    means = ", ".join(f"avg({f}) AS mean{i}" for i, f in enumerate(FEATURES))
    sd = "coalesce(nullif(stddev_samp({f}), 0), 1)"
    sds = ", ".join(f"{sd.format(f=f)} AS sd{i}" for i, f in enumerate(FEATURES))
    corr = ", ".join(
        f"covar_samp({FEATURES[a]}, {FEATURES[b]}) / ({sd.format(f=FEATURES[a])} * {sd.format(f=FEATURES[b])}) AS {cell('m', a, b)}"
        for a, b in CELLS
    )
    ctes = [f"axes0 AS (SELECT run_id, count(*) AS n, {means}, {sds}, {corr} FROM telemetry GROUP BY 1)"]
    square = {(a, b): " + ".join(f"{cell('s', a, k)} * {cell('s', k, b)}" for k in range(5)) for a, b in CELLS}
    squares = ", ".join(f"{sql_text} AS {cell('q', a, b)}" for (a, b), sql_text in square.items())
    trace = " + ".join(cell("q", a, a) for a in range(5))
    largest = "greatest(" + ", ".join(cell("s", a, a) for a in range(5)) + ")"
    for j in range(ks):
        ctes.append(f"""squared{j} AS (
      SELECT run_id, 0 AS step, {', '.join(f"{cell('m', a, b)} AS {cell('s', a, b)}" for a, b in CELLS)} FROM axes{j}
      UNION ALL
      SELECT run_id, step + 1, {', '.join(f"{cell('q', a, b)} / ({trace})" for a, b in CELLS)}
      FROM (SELECT run_id, step, {squares} FROM squared{j} WHERE step < 16))""")
        direction = ", ".join(
            f"CASE {largest} "
            + " ".join(f"WHEN {cell('s', c, c)} THEN {cell('s', i, c)} / sqrt({cell('s', c, c)})" for c in range(5))
            + f" END AS v{j}_{i}"
            for i in range(5)
        )
        value = " + ".join(f"v{j}_{a} * {cell('m', a, b)} * v{j}_{b}" for a in range(5) for b in range(5))
        left = ", ".join(f"{cell('m', a, b)} - l{j} * v{j}_{a} * v{j}_{b} AS {cell('m', a, b)}" for a, b in CELLS)
        ctes.append(f"""axes{j + 1} AS (
      SELECT * REPLACE ({left}) FROM (
        SELECT *, {value} AS l{j} FROM axes{j} JOIN (
          SELECT run_id, {direction} FROM squared{j} WHERE step = 16) USING (run_id)))""")
    xs = ", ".join(f"({f} - mean{i}) / sd{i} AS x{i}" for i, f in enumerate(FEATURES))
    dots = ", ".join(" + ".join(f"v{j}_{i} * x{i}" for i in range(5)) + f" AS p{j}" for j in range(ks))
    errors = ", ".join(
        "sqrt("
        + " + ".join("pow(x{i} - ({t}), 2)".format(i=i, t=" + ".join(f"v{j}_{i} * p{j}" for j in range(k))) for i in range(5))
        + f") AS err_{k}"
        for k in range(1, ks + 1)
    )
    ctes.append(f"errors AS (SELECT run_id, {errors} FROM (SELECT *, {dots} FROM (SELECT axes{ks}.*, {xs} FROM telemetry "
                f"JOIN axes{ks} USING (run_id))))")
    return tuple(ctes)


@query(
    "pca_train",
    with_ctes(
        T,
        *training_sql(3),
        select=f"""
    SELECT run_id, 3 AS n_components, n AS rows_used, round(threshold, 6) AS threshold,
           {', '.join(f'round(l{j}, 6) AS variance_{j}' for j in range(3))},
           {', '.join(f'round(v{j}_{i}, 6) AS component_{j}_{i}' for j in range(3) for i in range(5))}
    FROM axes3 JOIN (SELECT run_id, quantile_disc(err_3, 0.995) AS threshold FROM errors GROUP BY 1) USING (run_id)""",
    ),
)
def pca_train(spark, sf_dir):
    models = training.train_models(telemetry(spark, sf_dir))
    return rounded(
        models.selectExpr(
            "run_id",
            "model.model.n_components",
            "model.meta.rows_used",
            "model.thresholds.reconstruction_error AS threshold",
            *[f"model.model.explained_variance[{j}] AS variance_{j}" for j in range(3)],
            *[f"model.model.components[{j}][{i}] AS component_{j}_{i}" for j in range(3) for i in range(5)],
        )
    )


SWEEP = Sweep("grid", (1, 2, 3, 4), (95.0, 99.0, 99.5))


@query(
    "tuning_sweep",
    with_ctes(
        T,
        *training_sql(4),
        "trials AS ("
        + " UNION ALL ".join(
            f"SELECT run_id, {t} AS trial_index, {k} AS n_components, {p}e0 AS percentile, "
            f"quantile_disc(err_{k}, {p / 100!r}) AS selection_metric_value FROM errors GROUP BY 1"
            for t, (k, p) in enumerate(SWEEP.trials())
        )
        + ")",
        select="""
    SELECT run_id, trial_index, n_components, percentile, round(selection_metric_value, 6) AS selection_metric_value,
           row_number() OVER (PARTITION BY run_id ORDER BY selection_metric_value, trial_index) = 1 AS is_best
    FROM trials""",
    ),
)
def tuning_sweep(spark, sf_dir):
    return rounded(run_sweep(telemetry(spark, sf_dir), SWEEP))


@query("tuning_sweep_hot", CHECKS["tuning_sweep"])
def tuning_sweep_hot(spark, sf_dir):
    """As if every run were too large for a task."""
    return rounded(run_sweep(telemetry(spark, sf_dir), SWEEP, group_rows=HOT_ROWS))


@query(
    "artifact_round_trip",
    sql("SELECT dataset_id, round(avg(reconstruction_error), 6) AS mean_error, count_if(predicted_is_anomaly) AS flagged "
        "FROM scored GROUP BY 1"),
)
def artifact_round_trip(spark, sf_dir):
    """Scores of a model that was written as a JSON artifact and read back."""
    path = scratch_path(spark, "model")
    write_model(spark, M, path)
    rows = dataset_scores(telemetry(spark, sf_dir), read_model(spark, path), MODEL_ID)
    return rounded(
        rows.groupBy("dataset_id").agg(
            F.avg("reconstruction_error").alias("mean_error"), F.count_if("predicted_is_anomaly").alias("flagged")
        )
    )


@query(
    "rescore_replaces",
    sql("""
    SELECT dataset_id, model_run_id, count(*) AS scores, count_if(predicted_is_anomaly) AS flagged
    FROM scored GROUP BY 1, 2"""),
)
def rescore_replaces(spark, sf_dir):
    """Scoring twice leaves one score per record."""
    path = scratch_path(spark, "scores")
    for _ in range(2):
        write_scores(scored(spark, sf_dir), path)
    return read_scores(spark, path).groupBy("dataset_id", "model_run_id").agg(
        F.count(F.lit(1)).alias("scores"), F.count_if("predicted_is_anomaly").alias("flagged")
    )


@query(
    "score_browse",
    sql("""
    SELECT dataset_id, record_id, model_run_id, round(reconstruction_error, 6) AS reconstruction_error,
           predicted_is_anomaly, metric_timestamp, host_id, is_anomaly AS label
    FROM scored WHERE predicted_is_anomaly AND reconstruction_error >= 2 AND reconstruction_error <= 5
    ORDER BY scored.reconstruction_error DESC, record_id DESC LIMIT 100 OFFSET 50"""),
)
def score_browse(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return rounded(score_ops.browse_scores(scored(spark, sf_dir), rows, 100, 50, True, 2.0, 5.0))


ORPHANED = """
moved AS (
  SELECT * REPLACE (CASE WHEN host_id LIKE '%7' THEN record_id + 1000000000 ELSE record_id END AS record_id) FROM scored)
"""


def moved_scores(spark, sf_dir):
    """Scores of some hosts get record ids that do not exist."""
    rows = telemetry(spark, sf_dir).withColumn(
        "record_id", F.when(F.col("host_id").endswith("7"), F.col("record_id") + 1_000_000_000).otherwise(F.col("record_id"))
    )
    return dataset_scores(rows, M, MODEL_ID)


@query(
    "score_orphans",
    sql(
        """
    SELECT record_id, dataset_id, model_run_id, round(reconstruction_error, 6) AS reconstruction_error,
           predicted_is_anomaly
    FROM moved WHERE NOT EXISTS (SELECT 1 FROM telemetry t WHERE t.record_id = moved.record_id)""",
        ORPHANED,
    ),
)
def score_orphans(spark, sf_dir):
    return rounded(score_ops.orphaned_scores(moved_scores(spark, sf_dir), telemetry(spark, sf_dir)))


@query(
    "score_browse_summary",
    sql(
        """
    SELECT dataset_id, model_run_id, round(min(reconstruction_error), 6) AS min_score,
           round(max(reconstruction_error), 6) AS max_score, count_if(predicted_is_anomaly) AS total,
           count_if(record_id >= 1000000000) AS orphans
    FROM moved GROUP BY 1, 2""",
        ORPHANED,
    ),
)
def score_browse_summary(spark, sf_dir):
    return rounded(
        score_ops.browse_summary(moved_scores(spark, sf_dir), telemetry(spark, sf_dir), only_anomalies=True)
    )


@query(
    "score_range",
    sql("""
    SELECT dataset_id, model_run_id, round(min(reconstruction_error), 6) AS min_score,
           round(max(reconstruction_error), 6) AS max_score FROM scored GROUP BY 1, 2"""),
)
def score_range(spark, sf_dir):
    return rounded(score_ops.score_range(scored(spark, sf_dir)))


def distribution_sql(dimension: str) -> str:
    return sql(f"""
    SELECT dataset_id, model_run_id, coalesce({dimension}, '') AS label, count(*) AS count,
           round(avg(reconstruction_error), 6) AS mean, round(quantile_cont(reconstruction_error, 0.5), 6) AS p50,
           round(quantile_cont(reconstruction_error, 0.95), 6) AS p95
    FROM scored GROUP BY 1, 2, 3""")


def distribution(dimension: str):
    def build(spark, sf_dir):
        return rounded(score_ops.error_distribution(scored(spark, sf_dir), telemetry(spark, sf_dir), dimension))

    return build


for _dimension in ("region", "anomaly_type", "project_id"):
    query(f"error_distribution_{_dimension}", distribution_sql(_dimension))(distribution(_dimension))


@query(
    "confusion",
    sql("""
    SELECT dataset_id, model_run_id, count_if(predicted_is_anomaly AND is_anomaly) AS tp,
           count_if(predicted_is_anomaly AND NOT is_anomaly) AS fp,
           count_if(NOT predicted_is_anomaly AND NOT is_anomaly) AS tn,
           count_if(NOT predicted_is_anomaly AND is_anomaly) AS fn
    FROM scored GROUP BY 1, 2"""),
)
def confusion(spark, sf_dir):
    return score_ops.confusion(score_ops.labelled_scores(scored(spark, sf_dir), telemetry(spark, sf_dir)))


@query(
    "roc_pr",
    sql(
        """
    SELECT c.dataset_id, c.model_run_id, c.point, round(c.threshold, 6) AS threshold,
           round(count_if(NOT s.is_anomaly) / any_value(c.neg), 6) AS fpr,
           round(count_if(s.is_anomaly) / any_value(c.pos), 6) AS tpr,
           round(count_if(s.is_anomaly) / count(*), 6) AS precision,
           round(count_if(s.is_anomaly) / any_value(c.pos), 6) AS recall
    FROM cuts c JOIN scored s ON s.dataset_id = c.dataset_id AND s.reconstruction_error >= c.threshold
    GROUP BY 1, 2, 3, c.threshold""",
        """
    by_error AS (
      SELECT dataset_id, model_run_id, reconstruction_error, count(*) OVER w AS n,
             count_if(is_anomaly) OVER w AS pos, count_if(NOT is_anomaly) OVER w AS neg,
             row_number() OVER (PARTITION BY dataset_id ORDER BY reconstruction_error DESC) - 1 AS rn
      FROM scored WINDOW w AS (PARTITION BY dataset_id)),
    cuts AS (
      SELECT dataset_id, model_run_id, CAST(i AS INTEGER) AS point, reconstruction_error AS threshold, pos, neg
      FROM by_error JOIN range(50) AS pts(i) ON rn = CAST(floor(CAST(i AS DOUBLE) / 49 * (n - 1)) AS BIGINT))""",
    ),
)
def roc_pr(spark, sf_dir):
    labelled = score_ops.labelled_scores(scored(spark, sf_dir), telemetry(spark, sf_dir))
    return rounded(score_ops.curves(labelled, 50))


@query("roc_pr_hot", CHECKS["roc_pr"])
def roc_pr_hot(spark, sf_dir):
    """As if every scored dataset were too large for a task."""
    labelled = score_ops.labelled_scores(scored(spark, sf_dir), telemetry(spark, sf_dir))
    return rounded(score_ops.curves(labelled, 50, HOT_ROWS))


@query(
    "scored_datasets",
    with_ctes(
        GENERATION_RUNS_SQL,
        SCORE_HISTORY_SQL,
        select="""
    SELECT dataset_id, model_run_id, max(scored_at) AS scored_at, any_value(created_at) AS created_at
    FROM score_history JOIN generation_runs ON run_id = dataset_id GROUP BY 1, 2""",
    ),
)
def scored_datasets(spark, sf_dir):
    return score_ops.scored_datasets(score_history(spark, sf_dir), generation_runs(spark, sf_dir))


NOW = datetime(2024, 2, 10)
KEPT = "kept AS (SELECT * FROM telemetry WHERE ingestion_time >= TIMESTAMP '2024-02-10' - INTERVAL 21 DAY)"


@query(
    "retention_telemetry",
    sql("SELECT run_id, record_id, ingestion_time, host_id FROM kept", KEPT),
)
def retention_telemetry(spark, sf_dir):
    kept = lifecycle.retained_telemetry(telemetry(spark, sf_dir), NOW, 21)
    return kept.select("run_id", "record_id", "ingestion_time", "host_id")


@query(
    "retention_scores",
    sql(
        """
    SELECT record_id, dataset_id, model_run_id, round(reconstruction_error, 6) AS reconstruction_error,
           predicted_is_anomaly
    FROM scored WHERE record_id IN (SELECT record_id FROM kept)""",
        KEPT,
    ),
)
def retention_scores(spark, sf_dir):
    kept = lifecycle.retained_telemetry(telemetry(spark, sf_dir), NOW, 21)
    return rounded(lifecycle.retained_scores(scored(spark, sf_dir), kept))


@query(
    "latest_reading",
    sql("""
    SELECT run_id, host_id, record_id, metric_timestamp FROM telemetry
    QUALIFY row_number() OVER (PARTITION BY run_id, host_id ORDER BY metric_timestamp DESC, record_id DESC) = 1"""),
)
def latest_reading(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("run_id", "host_id", "record_id", "metric_timestamp")
    return latest_per(rows, ["run_id", "host_id"], [F.desc("metric_timestamp"), F.desc("record_id")])
