from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostvane.operators.ranks import Quantile, aggregate, group_sizes, values_at_ranks
from hostvane.session import clear_scratch, materialize


WANTED = {
    "median": Quantile("v", 0.5),
    "high": Quantile("v", 0.95),
    "nearest": Quantile("v", 0.95, nearest=True),
    "other": Quantile("w", 0.25),
}


def frame(spark, groups):
    rows = [(g, float(v), float(-v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double, w double").repartition(3)


def as_dict(df):
    return {r["g"]: {n: r[n] for n in WANTED} for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_narrowing_equals_built_in(spark, seed):
    draw = np.random.default_rng(seed)
    groups = {
        "wide": np.round(draw.lognormal(0, 4, 400), 3),
        "ties": draw.integers(0, 4, 300),
        "flat": np.full(50, 7.0),
        "mixed": np.concatenate([draw.normal(0, 1e-6, 100), [-1e300, 1e300, 0.0]]),
        "small": draw.normal(0, 1, 5),
    }
    df = frame(spark, groups)
    exact = as_dict(aggregate(df, ["g"], [F.count("v").alias("n")], WANTED))
    narrowed = as_dict(aggregate(df, ["g"], [F.count("v").alias("n")], WANTED, group_rows=10))
    assert exact.keys() == narrowed.keys() == groups.keys()
    for g, values in groups.items():
        for name in WANTED:
            assert narrowed[g][name] == pytest.approx(exact[g][name], rel=1e-12, abs=1e-300)
        ordered = np.sort(values)
        assert exact[g]["nearest"] == ordered[max(int(np.ceil(0.95 * len(ordered))) - 1, 0)]
        assert exact[g]["median"] == pytest.approx(np.quantile(ordered, 0.5), rel=1e-12, abs=1e-300)


def test_infinities_and_nan_do_not_stall(spark):
    values = [float("-inf"), -1.0, 0.0, 2.0, 3.0, 5.0, float("inf"), float("inf"), float("nan")]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    targets = spark.createDataFrame([("a", i, i) for i in range(8)], "g string, _tag int, _rank long")
    got = {r["_tag"]: r["_value"] for r in values_at_ranks(df, targets, ["g"], "v").collect()}
    assert [got[i] for i in range(8)] == values[:8]


def test_null_keys_and_values(spark):
    rows = [(None, float(i)) for i in range(30)] + [("b", float(i)) for i in range(40)] + [("b", None)] * 5
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"m": Quantile("v", 0.5)}
    built_in = {r["g"]: r["m"] for r in aggregate(df, ["g"], [], wanted).collect()}
    narrowed = {r["g"]: r["m"] for r in aggregate(df, ["g"], [], wanted, group_rows=8).collect()}
    assert built_in == narrowed == {None: 14.5, "b": 19.5}


@pytest.mark.parametrize("counted", [False, True])
def test_large_groups_without_values_stay(spark, counted):
    plain = [F.count(F.lit(1)).alias("n")] if counted else []
    rows = [("a", float(i), float(i)) for i in range(20)] + [("b", None, float(i)) for i in range(20)] + [("c", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    wanted = {"m": Quantile("v", 0.5), "x": Quantile("w", 0.5)}
    few = sorted(map(tuple, aggregate(df, ["g"], plain, wanted).collect()))
    many = sorted(map(tuple, aggregate(df, ["g"], plain, wanted, group_rows=8).collect()))
    assert few == many and [r[0] for r in many] == ["a", "b", "c"]
    assert many[1][-2:] == (None, 9.5)


def test_scans_do_not_grow_with_columns(spark, tmp_path):
    """The source is read a fixed number of times, however many columns, ranks and rounds there are."""
    draw = np.random.default_rng(0)
    rows = [("a" if i % 3 else "b", *map(float, draw.lognormal(0, 3, 5))) for i in range(600)] + [("c", *[1.0] * 5)]
    spark.createDataFrame(rows, "g string, v0 double, v1 double, v2 double, v3 double, v4 double").write.parquet(f"{tmp_path}/t")
    reads: list = []
    source = spark.read.parquet(f"{tmp_path}/t")
    names = {f"q{c}_{int(p * 10)}": Quantile(f"v{c}", p) for c in range(5) for p in (0.5, 0.9)}
    from hostvane.operators import ranks

    kept, count = ranks.materialize, [0]

    def noted(df, label):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        reads.append(plan.count("v0#") > 0 and label)
        count[0] += 1
        return kept(df, label)

    ranks.materialize = noted
    try:
        out = aggregate(source, ["g"], [F.count(F.lit(1)).alias("n")], names, group_rows=50)
    finally:
        ranks.materialize = kept
    assert [r for r in reads if r] == ["hot", "values"]  # sizes and the narrow table; rounds read only that
    final = out._jdf.queryExecution().optimizedPlan().toString()
    assert final.count("v0#") and sum("parquet" in line and "v0#" in line for line in final.splitlines()) <= 2
    assert out.count() == 3 and count[0] <= 12


def test_group_sizes(spark):
    assert group_sizes(frame(spark, {"a": [1, 2, 3], "b": [1]}), ["g"]) == (3, 4)
    assert group_sizes(frame(spark, {"a": [1]}).where("false"), ["g"]) == (0, 0)


def test_quantiles_need_a_group(spark):
    with pytest.raises(ValueError):
        aggregate(frame(spark, {"a": [1]}), [], [], WANTED)


def test_intermediate_tables_can_be_cleared(spark):
    kept = materialize(frame(spark, {"a": [1, 2]}), "kept")
    assert kept.count() == 2
    assert clear_scratch(spark)
    assert not clear_scratch(spark)
