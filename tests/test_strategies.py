"""Guards, splits and choices over several strategies, on small tables against plain readings."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.functions.quantiles import group_quantiles
from quayside.plans import recursive, strategies

DAY = dt.date(2000, 6, 1)
SCHEMA = "product_id string, origin date, horizon int, target_date date, available boolean, actual double, model string, pred double"


def _rows(spark, rows, strategy="direct", more=None):
    """rows: product, horizon, available, actual, model, pred."""
    made = [(p, DAY, h, DAY + dt.timedelta(h), a, y, m, x) for p, h, a, y, m, x in rows]
    df = spark.createDataFrame(made, SCHEMA)
    return strategies.strategy_rows({strategy: [df if more is None else more(df)]}, F.lit("development"))


def test_group_quantiles_are_those_of_each_group(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, 1.5, r.random(), float(r.randrange(5))])) for _ in range(4000)]
    rows += [("one", 1, 7.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, x double").repartition(7)
    got = {(g.k, g.j): g for g in group_quantiles(df, ["k", "j"], "x", {"low": 0.1, "p99": 0.99, "top": 1.0}).collect()}
    groups = {}
    for k, j, x in rows:
        if x is not None:
            groups.setdefault((k, j), []).append(x)
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert [got[g].low, got[g].p99, got[g].top] == pytest.approx(np.quantile(xs, [0.1, 0.99, 1.0]).tolist())
    assert group_quantiles(df.where("false"), ["k", "j"], "x", {"q": 0.5}).collect() == []


def _state(spark, values, product="p"):
    rows = [(product, DAY - dt.timedelta(len(values) - 1 - i), v, v, v is not None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "product_id string, date_key date, quantity double, qty_available double, available boolean")


def test_growth_is_stopped_by_the_limit_and_by_the_bounds(spark):
    """Ten times as much as a week ago: growth explodes at once; within bounds of +-1 it grows by e over the baseline."""
    state = _state(spark, [100.0] * 13 + [1000.0])
    free = recursive.forecast(state, [str(DAY)], recursive.growth_step).orderBy("horizon").collect()
    assert free[0].pred == 10_000 and not free[0].catastrophic  # 1,000 * 1,000 / 100; the limit is 50 times the largest
    assert free[1].catastrophic and free[1].fallback_used and free[1].pred == pytest.approx(100.0) and free[1].safety_limit == 50_000
    kept = recursive.forecast(state, [str(DAY)], recursive.growth_step, bounds=(-1.0, 1.0)).orderBy("horizon").collect()
    assert kept[0].residual_guard and kept[0].residual == pytest.approx(math.log(10_001 / 101)) and kept[0].pred == pytest.approx(101 * math.e - 1)
    assert not kept[0].fallback_used and all(r.pred < 50_000 for r in kept)
    # nothing a week ago: no residual, which is no bound's doing, and the baseline stands in
    none = recursive.forecast(_state(spark, [5.0, 6.0]), [str(DAY)], recursive.growth_step, bounds=(-1.0, 1.0)).orderBy("horizon").first()
    assert none.residual_nonfinite and none.nonfinite and none.fallback_used and not none.residual_guard and none.pred == 5.5


def test_common_rows_need_every_model_of_the_strategy(spark):
    rows = _rows(spark, [
        ("a", 1, True, 1.0, "x", 1.0), ("a", 1, True, 1.0, "y", 2.0), ("b", 1, True, 1.0, "x", 1.0), ("b", 1, True, 1.0, "y", None), ("c", 1, True, 1.0, "x", 1.0),
        ("d", 1, None, 1.0, "x", 1.0), ("d", 1, None, 1.0, "y", 1.0), ("e", 1, True, None, "x", 1.0), ("e", 1, True, None, "y", 1.0),
        ("f", 1, True, 1.0, "x", 1.0), ("f", 1, True, 1.0, "x", 1.0), ("g", 1, True, 1.0, "x", math.inf), ("g", 1, True, 1.0, "y", 1.0), ("a", 1, True, 1.0, "other", None),
    ])
    got = strategies.with_common(rows, {"direct": ["x", "y"]})
    assert {(r.product_id, r.model) for r in got.where("common").collect()} == {("a", "x"), ("a", "y")}
    assert got.where("model = 'other'").count() == 0


def test_a_blend_needs_all_members_and_has_no_guards(spark):
    guards = lambda df: df.withColumns({"fallback_used": F.lit(True), "safety_limit": F.lit(9.0)})
    rows = _rows(spark, [("a", 1, True, 1.0, "x", 1.0), ("a", 1, True, 1.0, "y", 3.0), ("b", 1, True, 1.0, "x", 1.0), ("b", 1, True, 1.0, "y", math.nan), ("c", 1, True, 1.0, "y", 2.0)], more=guards)
    assert rows.where("fallback_used and safety_limit = 9 and not catastrophic and residual_min is null").count() == 5
    got = {r.product_id: r for r in strategies.blended(rows, {"direct": {"x": 0.25, "y": 0.75}}).collect()}
    assert (got["a"].pred, got["b"].pred, got["c"].pred) == (2.5, None, None)
    assert all(not r.fallback_used and r.safety_limit is None and r.model == "ensemble" for r in got.values())


def test_diagnostics_count_guards_and_skip_what_is_not_finite(spark):
    def more(df):
        return df.withColumns({"catastrophic": F.col("pred") > 40, "residual_guard": F.col("horizon") == 1, "residual_min": F.when(F.col("horizon") == 1, -2.0).otherwise(F.lit(math.inf)), "safety_limit": F.lit(50.0)})

    rows = _rows(spark, [("a", 1, True, 10.0, "x", 50.0), ("a", 2, True, 20.0, "x", 1.0), ("a", 3, True, None, "x", math.nan), ("a", 4, True, math.inf, "x", None), ("a", 1, True, 10.0, "y", None)], more=more)
    got = {r.model: r for r in strategies.diagnostics(rows).collect()}
    x, y = got["x"], got["y"]
    assert (x.n_rows, x.n_finite, x.coverage, x.residual_guard_count, x.residual_guard_rate) == (4, 2, 0.5, 1, 0.25)
    assert (x.largest, x.observed_max, x.ratio, x.safety_limit, x.residual_min, x.residual_max) == (50.0, 20.0, 2.5, 50.0, -2.0, None)
    assert x.p99 == pytest.approx(np.quantile([50, 1], 0.99)) and (y.n_finite, y.largest, y.p99, y.observed_max) == (0, None, None, 20.0)
    assert strategies.diagnostics(rows.where("false")).collect() == []


def test_top_demand_counts_a_key_once_and_errors_are_ranked(spark):
    rows = [(f"p{i}", h, True, float(10 * i + h), m, 0.0 if m == "x" else 10.0 * i) for i in range(5) for h in (1, 2) for m in ("x", "y")]
    common = strategies.with_common(_rows(spark, rows), {"direct": ["x", "y"]})
    top = {r.model: r for r in strategies.top_demand(common, {"direct": ["x", "y"]}, 0.75).collect()}
    limit = np.quantile([10 * i + h for i in range(5) for h in (1, 2)], 0.75)
    assert top["x"].threshold == pytest.approx(limit) and top["x"].n == 3 and top["x"].mae == pytest.approx((32 + 41 + 42) / 3) and top["y"].mae == pytest.approx(5 / 3)
    errors = strategies.largest_errors(common, 2).where("model = 'x'").orderBy("rank").collect()
    assert [(r.product_id, r.horizon, r.signed_error, r.absolute_error) for r in errors] == [("p4", 2, -42.0, 42.0), ("p4", 1, -41.0, 41.0)]
    # ties go by product, origin and horizon
    tied = strategies.largest_errors(common.withColumn("pred", F.col("actual")), 1).where("model = 'x'").first()
    assert (tied.product_id, tied.horizon) == ("p0", 1)
    with pytest.raises(ValueError):
        strategies.top_demand(common, {"direct": ["x"]}, 0.3)


def test_the_choice_takes_an_ensemble_only_where_it_was_accepted(spark):
    scores = spark.createDataFrame([("direct", "x", 0.5), ("direct", "ensemble", 0.4995), ("recursive", "x", 0.7), ("recursive", "ensemble", 0.6), ("recursive", "z", None)], "strategy string, model string, wape double")
    accepted = strategies.accepted_ensembles(scores)
    assert [r.strategy for r in accepted.collect()] == ["recursive"]

    def chosen(**how):
        return [(r.model, r.strategy) for r in strategies.canonical(scores, accepted, **how).collect()]

    assert chosen() == [("x", "direct")] and chosen(strategy="recursive") == [("ensemble", "recursive")]
    assert chosen(model="ensemble") == [("ensemble", "direct")] and chosen(model="x", strategy="recursive") == [("x", "recursive")]
    assert chosen(model="z") == [] and chosen(model="unknown") == []
