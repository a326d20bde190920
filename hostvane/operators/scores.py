"""Score tables joined with their telemetry: browsing, distribution, orphans, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostvane.functions import checks
from hostvane.operators.joins import join_checked
from hostvane.operators.paging import page
from hostvane.operators.ranks import (
    GROUP_ROWS,
    Quantile,
    aggregate,
    group_sizes,
    hot_groups,
    keyed_join,
    values_at_ranks,
)
from hostvane.schemas import ERROR_DIMENSIONS, SCORE_KEYS
from hostvane.session import materialize

ERROR = "reconstruction_error"

# Score range reported for a model that has no scores, and curve resolution.
EMPTY_RANGE = (0.0, 10.0)
DEFAULT_POINTS, FEWEST_POINTS, MOST_POINTS = 50, 2, 1000
PAGE_ROWS = 10_000


def with_telemetry(scores: DataFrame, telemetry: DataFrame, *columns: str | Column) -> DataFrame:
    """Scores joined with the named columns of the records they were computed from.

    The key is (run, record): record ids are unique, so the shuffle is even, and a filter
    on the dataset prunes both sides.
    """
    records = telemetry.select(F.col("run_id").alias("dataset_id"), "record_id", *columns)
    return scores.join(records, ["dataset_id", "record_id"])


def score_filter(
    scores: DataFrame, only_anomalies: bool = False, min_score: float | None = None, max_score: float | None = None
) -> DataFrame:
    if only_anomalies:
        scores = scores.where("predicted_is_anomaly")
    if min_score is not None:
        scores = scores.where(F.col(ERROR) >= F.lit(float(min_score)))
    if max_score is not None:
        scores = scores.where(F.col(ERROR) <= F.lit(float(max_score)))
    return scores


def browse_scores(
    scores: DataFrame,
    telemetry: DataFrame,
    limit: int = 50,
    offset: int = 0,
    only_anomalies: bool = False,
    min_score: float | None = None,
    max_score: float | None = None,
) -> DataFrame:
    """A page of scores with their records, worst first, ties by newest record.

    The page is cut among scores whose record exists, by key alone; only its rows meet the records' columns.
    """
    order, keys = [F.desc(ERROR), F.desc("record_id")], ["dataset_id", "record_id"]
    wanted = score_filter(scores, only_anomalies, min_score, max_score)
    records = telemetry.withColumnRenamed("run_id", "dataset_id")
    cut = page(wanted.join(records.select(*keys), keys, "left_semi"), order, limit, offset)
    columns = [*keys, "metric_timestamp", "host_id", F.col("is_anomaly").alias("label")]
    few = limit <= PAGE_ROWS  # a page is no larger than that, so nothing has to be counted
    rows = records.select(*columns).join(F.broadcast(cut), keys) if few else join_checked(records.select(*columns), cut, keys)
    return rows.select(*wanted.columns, "metric_timestamp", "host_id", "label").orderBy(*order)


def orphaned_scores(scores: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Scores whose record no longer exists."""
    return scores.join(telemetry.select("record_id"), "record_id", "left_anti")


def score_range(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*SCORE_KEYS).agg(F.min(ERROR).alias("min_score"), F.max(ERROR).alias("max_score"))


def score_range_of(scores: DataFrame, dataset_id: str, model_run_id: str) -> DataFrame:
    """One row in any case; a model without scores reports the default range."""
    low, high = EMPTY_RANGE
    mine = scores.where((F.col("dataset_id") == dataset_id) & (F.col("model_run_id") == model_run_id))
    return mine.agg(
        F.coalesce(F.min(ERROR), F.lit(low)).alias("min_score"),
        F.coalesce(F.max(ERROR), F.lit(high)).alias("max_score"),
    )


def browse_summary(
    scores: DataFrame, telemetry: DataFrame, only_anomalies: bool = False, min_score=None, max_score=None
) -> DataFrame:
    """What a score browser shows around its page: matching total, orphans and the unfiltered range."""
    total = score_filter(scores, only_anomalies, min_score, max_score).groupBy(*SCORE_KEYS).agg(
        F.count(F.lit(1)).alias("total")
    )
    orphans = orphaned_scores(scores, telemetry).groupBy(*SCORE_KEYS).agg(F.count(F.lit(1)).alias("orphans"))
    keys = list(SCORE_KEYS)
    return (
        score_range(scores)
        .join(total, keys, "left")
        .join(orphans, keys, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "orphans")})
    )


def error_distribution(
    scores: DataFrame, telemetry: DataFrame, group_by: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Error statistics per value of a dimension; a missing value is shown as ''."""
    checks.one_of(group_by, ERROR_DIMENSIONS, "group_by")
    label = F.coalesce(F.col(group_by), F.lit("")).alias("label")
    rows = with_telemetry(scores, telemetry, group_by).select(*SCORE_KEYS, label, ERROR)
    # A group is no larger than its model's scores; only if those are large is the join written for several passes.
    counted = scores.select(*SCORE_KEYS, F.lit("").alias("label"))
    if group_sizes(counted, SCORE_KEYS)[0] > group_rows:
        rows, counted = materialize(rows, "joined"), None
    return aggregate(
        rows,
        [*SCORE_KEYS, "label"],
        [F.count(F.lit(1)).alias("count"), F.avg(ERROR).alias("mean")],
        {"p50": Quantile(ERROR, 0.5), "p95": Quantile(ERROR, 0.95)},
        group_rows,
        counted,
    )


def scored_datasets(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Each dataset a model has scored, once, with the time of its latest score."""
    latest = scores.groupBy("model_run_id", "dataset_id").agg(F.max("scored_at").alias("scored_at"))
    return latest.join(runs.select(F.col("run_id").alias("dataset_id"), "created_at"), "dataset_id")


def confusion(labelled: DataFrame) -> DataFrame:
    """Predicted flag against label, per dataset and model."""
    hit, label = F.col("predicted_is_anomaly"), F.col("label")
    return labelled.groupBy(*SCORE_KEYS).agg(
        F.count_if(hit & label).alias("tp"),
        F.count_if(hit & ~label).alias("fp"),
        F.count_if(~hit & ~label).alias("tn"),
        F.count_if(~hit & label).alias("fn"),
    )


def labelled_scores(scores: DataFrame, telemetry: DataFrame) -> DataFrame:
    return with_telemetry(scores, telemetry, F.col("is_anomaly").alias("label"))


def curve_points(points: int) -> int:
    """0 asks for the usual number; other numbers are honoured or refused."""
    if points == 0:
        return DEFAULT_POINTS
    if not FEWEST_POINTS <= points <= MOST_POINTS:
        raise ValueError(f"points must be between {FEWEST_POINTS} and {MOST_POINTS}, got {points}")
    return points


def _first_reached(points: int) -> Column:
    """Index of the first threshold of the descending array ``_cuts`` that the error reaches.

    A binary search spelled as nested conditions, so it runs inside generated code.
    """

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {ERROR} >= _cuts[{mid}] THEN {search(low, mid)} ELSE {search(mid + 1, high)} END"

    return F.expr(search(0, points - 1))


def _curve_cuts(labelled: DataFrame, points: int, group_rows: int) -> DataFrame:
    """Per dataset and model, the thresholds: errors at evenly spaced ranks, largest first."""
    keys = list(SCORE_KEYS)
    # rank from the top, as a share of the last index
    shares = [i / (points - 1) for i in range(points)]

    def gathered(rows: DataFrame) -> DataFrame:
        ordered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(ERROR), asc=False).alias("_all"))
        last = F.size("_all") - 1
        wanted = F.expr("array(" + ", ".join(f"{s!r}D" for s in shares) + ")")
        picks = F.transform(wanted, lambda s: F.get(F.col("_all"), F.floor(s * last).cast("int")))
        return ordered.select(*keys, picks.alias("_cuts"))

    if group_sizes(labelled, keys)[0] <= group_rows:
        return gathered(labelled)
    hot, others = hot_groups(labelled, keys, group_rows)
    rows = keyed_join(labelled, hot, keys, "left_semi") if others else labelled
    last = F.col("_n") - 1
    wanted = [
        F.struct(F.lit(i).alias("_tag"), (last - F.floor(F.lit(s) * last)).cast("long").alias("_rank"))
        for i, s in enumerate(shares)
    ]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = values_at_ranks(rows, sizes.select(*keys, F.inline(F.array(*wanted))), keys, ERROR)
    pairs = F.sort_array(F.collect_list(F.struct("_tag", "_value")))
    cuts = found.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_value"]).alias("_cuts"))
    return cuts.unionByName(gathered(keyed_join(labelled, hot, keys, "left_anti"))) if others else cuts


def curves(labelled: DataFrame, points: int = DEFAULT_POINTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """ROC and precision-recall points over all rows, one row per dataset, model and point.

    Each row falls between two thresholds; only counts per interval are shuffled, and the
    running sums go over at most as many rows as there are points.
    """
    points = curve_points(points)
    keys = list(SCORE_KEYS)
    rows = materialize(labelled.select(*keys, ERROR, "label"), "labelled")
    cuts = materialize(_curve_cuts(rows, points, group_rows), "cuts")
    placed = join_checked(rows, cuts, keys, stored=True).select(*keys, "label", _first_reached(points).alias("point"))
    counts = placed.groupBy(*keys, "point").agg(
        F.count_if("label").alias("_pos"), F.count_if(~F.col("label")).alias("_neg")
    )
    frame = cuts.select(*keys, F.posexplode("_cuts").alias("point", "threshold"))
    window = Window.partitionBy(*keys).orderBy("point")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    filled = frame.join(counts, [*keys, "point"], "left").select(
        *keys, "point", "threshold",
        F.sum(F.coalesce("_pos", F.lit(0))).over(upto).alias("_tp"),
        F.sum(F.coalesce("_neg", F.lit(0))).over(upto).alias("_fp"),
        F.sum(F.coalesce("_pos", F.lit(0))).over(whole).alias("_p"),
        F.sum(F.coalesce("_neg", F.lit(0))).over(whole).alias("_n"),
    )
    tp, fp = F.col("_tp"), F.col("_fp")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return filled.select(
        *keys, "point", "threshold",
        ratio(fp, F.col("_n")).alias("fpr"),
        ratio(tp, F.col("_p")).alias("tpr"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("_p")).alias("recall"),
    )
