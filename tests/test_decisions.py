"""Recursive forecasts, context tables, choices and sinks on small frames with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quayside.operators import anomaly, context, select, tails, windows
from quayside.plans import direct, recursive
from quayside.sources import panel as source
from quayside.sources import sinks

DAY = dt.date(2025, 1, 1)


def state(spark, values, product=1):
    rows = [(product, DAY + dt.timedelta(i), v, v, v is not None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "product_id long, date_key date, qty_available double, quantity double, available boolean")


def test_recursion_feeds_back(spark):
    values = [float(i) for i in range(1, 31)]
    got = [r.pred for r in recursive.forecast(state(spark, values), ["2025-01-30"]).orderBy("horizon").collect()]
    for want in got:
        assert want == pytest.approx(sum(values[-28:]) / 28)
        values.append(want)


def test_recursion_edges(spark):
    origin = ["2025-01-03"]
    preds = lambda df, **k: [r.pred for r in recursive.forecast(df, origin, **k).orderBy("horizon").collect()]
    assert preds(state(spark, [None, None, None])) == [0.0] * 7
    assert preds(state(spark, [4.0, None, 6.0]), horizons=2) == [5.0, 5.0]
    assert preds(state(spark, [1.0, 2.0])) == []  # no row on the origin's day
    assert preds(state(spark, []), horizons=1) == []
    runaway = lambda h: F.element_at(h, -1) * 1e9
    assert preds(state(spark, [1.0, 2.0, 3.0]), step=runaway, horizons=3) == [2.0] * 3  # the week's median stands in
    assert preds(state(spark, [1.0, 2.0, 3.0]), step=lambda h: F.lit(float("nan")), horizons=1) == [2.0]


def test_generated_values_do_not_widen_the_limit(spark):
    """Steps of 9,000, 100,000 and 600 on a history up to 37: only the second is thrown out."""
    s = state(spark, [float(i % 7 + 31) for i in range(35)])
    step = lambda h: F.get(F.array(F.lit(9_000.0), F.lit(100_000.0), F.lit(600.0)), F.size(h) - 28)
    rows = recursive.forecast(s, ["2025-02-04"], step=step, horizons=3).orderBy("horizon").collect()
    assert [r.catastrophic for r in rows] == [False, True, False] and [r.fallback_used for r in rows] == [False, True, False]
    assert rows[0].safety_limit == rows[1].safety_limit == 10_000.0 and rows[2].pred == 600.0
    assert rows[1].pred == pytest.approx((36 % 7) + 31)  # the same weekday of four weeks is always the same


RAW = "product_id long, date_key date, available boolean, quantity_app double, quantity_web double, quantity double, is_promo boolean, campaign_web int, campaign_app int, discount_web double, discount_app double, price double"


def sales(spark, n, first=0, products=(1, 2)):
    rows = [(p, DAY + dt.timedelta(i), True, float(10 + i + p), 0.0, float(10 + i + p), False, -1, -1, 0.0, 0.0, 100.0) for p in products for i in range(first, n)]
    return spark.createDataFrame(rows, RAW)


def prepared(spark, n):
    return windows.with_state(source.fill_calendar(sales(spark, n)))


def test_rounds_feed_back_and_see_no_future_target(spark):
    history, ahead = prepared(spark, 35), sales(spark, 38, 35)
    predict = lambda panel: panel.withColumns({"pred": F.col("lag_0") + 1, "app_share": F.lit(0.25)})
    rows = recursive.forecast_with(history, ahead, predict, 3).orderBy("product_id", "horizon").collect()
    assert [r.pred for r in rows] == [46.0, 47.0, 48.0, 47.0, 48.0, 49.0]
    assert {r.origin for r in rows} == {DAY + dt.timedelta(34)} and rows[0].target_date == DAY + dt.timedelta(35) and rows[0].app_share == 0.25
    other = ahead.withColumn("quantity", F.lit(9e9))
    assert rows == recursive.forecast_with(history, other, predict, 3).orderBy("product_id", "horizon").collect()
    seen = []
    recursive.forecast_with(history, ahead, lambda p: seen.append(p.columns) or p.withColumn("pred", F.lit(1.0)), 1).count()
    step = recursive.step_panel(history, ahead)
    assert {r.horizon for r in step.collect()} == {1} and step.where("target is not null").count() == 0


def test_days_after_the_origin_change_nothing_at_it(spark):
    """A short history: the baseline falls back on what the origin knew, not on the days before the target."""
    rows, origin = prepared(spark, 12), DAY + dt.timedelta(4)
    later = F.col("date_key") > F.lit(origin)
    other = rows.withColumns({c: F.when(later, F.lit(99.0)).otherwise(F.col(c)) for c in ("quantity", "qty_available")})
    keep = ["product_id", "horizon", "pred_baseline", "pred_seasonal_naive", "pred_moving_avg"]
    at = lambda df: direct.naive_forecasts(df, [str(origin)]).select(*keep).orderBy(*keep[:2]).collect()
    assert at(rows) == at(other) and len(at(rows)) == 14
    assert at(rows)[4].pred_baseline == 13.0  # the median of the five days up to the origin


def test_one_step_panel_is_the_direct_panel_of_horizon_one(spark):
    rows = prepared(spark, 40)
    one = direct.direct_panel(rows, 1).orderBy("product_id", "origin").collect()
    assert one == direct.direct_panel(rows, 7).where("horizon = 1").orderBy("product_id", "origin").collect()


def test_future_panel_and_final_forecast(spark):
    history, ahead = prepared(spark, 35), sales(spark, 42, 35).withColumn("price", F.lit(50.0))
    panel = direct.direct_panel(history, 7, ahead, at_last=True, price=True)
    rows = {(r.product_id, r.horizon): r for r in panel.collect()}
    assert len(rows) == 14 and all(r.target is None and r.price == 50.0 and r.origin == DAY + dt.timedelta(34) for r in rows.values())
    assert rows[1, 3].season_7 == 10 + 30 + 1 and rows[1, 3].price_vs_origin == pytest.approx(math.log1p(50) - math.log1p(100))
    final = {(r.product_id, r.horizon): r for r in direct.final_naive(history, ahead).collect()}
    assert final[2, 7].pred_seasonal_naive == 10 + 34 + 2 and final[1, 1].pred_moving_avg == pytest.approx(sum(11 + i for i in range(7, 35)) / 28)
    with pytest.raises(ValueError):
        direct.direct_panel(history, 7, ahead.unionByName(ahead.limit(1)))


def test_weight_policies(spark):
    df = spark.createDataFrame([(4.0, 1.0, False, False, True), (4.0, -1.0, False, False, True), (None, None, False, False, True), (40.0, 1.0, True, False, True), (40.0, -1.0, True, False, True), (40.0, -1.0, False, True, True), (40.0, 1.0, False, False, False)], "s double, r double, e boolean, y boolean, a boolean")
    of = lambda policy: [round(x.w, 6) for x in df.select(anomaly.weights(F.col("s"), F.lit(2.0), F.col("r"), F.col("e"), policy, systemic=F.col("y"), available=F.col("a")).alias("w")).collect()]
    e = round(math.exp(-1), 6)
    assert of("downweight") == [e, e, 1.0, 0.65, 0.2, 0.5, 1.0]
    assert of("negative_only") == [1.0, e, 1.0, 1.0, 0.2, 0.5, 1.0]
    assert of("hard_example") == [2.0, 2.0, 1.0, 2.0, 2.0, 2.0, 1.0]
    assert of("signed") == [2.0, e, 1.0, 2.0, 0.2, 0.5, 1.0]
    soft = df.limit(1).select(anomaly.weights(F.lit(2.5), F.lit(2.0), F.lit(1.0), F.lit(False), "hard_example").alias("w")).first().w
    assert soft == pytest.approx(math.exp(0.25))


def test_tail_threshold(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = (r.pareto(4, 6000) * 2).tolist()
    df = spark.createDataFrame([(i % 10, DAY + dt.timedelta(i // 10), v) for i, v in enumerate(x)], "product_id long, date_key date, score double")
    t = tails.tail_threshold(df).first()
    assert t.method == "evt_pot_gpd" and 0.1 < t.xi < 0.45 and t.threshold == pytest.approx(2 * (0.01**-0.25 - 1), rel=0.12) and t.n_total == 4800
    few = tails.tail_threshold(df.limit(50)).first()
    assert few.method == "empirical_quantile_small_sample" and tails.tail_threshold(df.limit(0)).first().threshold == float("inf")
    q = spark.range(1).select(tails.gpd_quantile(F.lit(0.01), F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(0.1)).alias("a"), tails.gpd_quantile(F.lit(0.2), F.lit(2.0), F.lit(0.3), F.lit(1.0), F.lit(0.1)).alias("b")).first()
    assert q.a == pytest.approx(2 + math.log(10)) and q.b == 2.0


def test_exact_quantiles(spark):
    from quayside.functions.quantiles import exact_quantiles

    df = spark.range(1001).select((F.col("id") * 8 % 1001).cast("double").alias("x")).repartition(5)
    assert tuple(exact_quantiles(df, "x", {"a": 0.0, "b": 0.25, "c": 0.9995, "d": 1.0}).first()) == (0.0, 250.0, 999.5, 1000.0)
    assert exact_quantiles(df.where("x < 0"), "x", {"a": 0.5}).first().a is None


def test_pairing_and_stability(spark):
    s = state(spark, [2.0] * 10)
    paired = recursive.with_actuals(recursive.forecast(s, ["2025-01-05"]), s)
    r = recursive.stability(paired).first()
    assert paired.count() == 5 and (r.wape, r.ratio, r.passes) == (0.0, 1.0, True)
    keep = ["product_id", "origin", "horizon", "actual", "available"]
    named = paired.withColumn("model", F.lit("m"))
    other = named.select(*keep, "model", (F.col("pred") + 1).alias("pred"))
    rows = {r.metric: r for r in recursive.compare(other, named).collect()}
    assert (rows["mae"].direct, rows["mae"].recursive, rows["bias"].winner) == (1.0, 0.0, "recursive")


def test_context(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, None), (None, "b")], "x double, c string")
    assert {(r.value, r.share) for r in context.category_shares(df, ["c"]).collect()} == {("a", 0.5), ("b", 0.25), ("missing", 0.25)}
    r = context.robust_scale(df, ["x"]).first()
    assert r["median"] == 2.0 and r["scale"] == pytest.approx(1 / 1.349)
    assert context.robust_scale(df.select(F.lit(5.0).alias("x")), ["x"]).first()["scale"] == 1.0
    assert context.category_shares(df.limit(0), ["c"]).count() == 0
    lift = context.weekly_lift(state(spark, [1.0] * 7 + [2.0] * 7)).first()
    assert (lift.recent_mean, lift.before, lift.lift, lift.percentile) == (2.0, 1.0, 1.0, 1.0)
    split = df.limit(1).select(*[context.split_of(F.lit(d).cast("date"), "2025-01-01", "2025-02-01", "2025-03-01") for d in ("2025-01-01", "2025-01-02", "2025-03-01", "2025-03-02", None)])
    assert list(split.first()) == ["train", "validation", "calibration", "holdout", "ignored"]
    ranks = df.withColumn("k", F.lit(1)).select("x", context.empirical_rank("k", "x").alias("r")).collect()
    assert {r.x: r.r and round(r.r, 6) for r in ranks} == {1.0: 0.333333, 2.0: 0.666667, 3.0: 1.0, None: None}


def test_role_overlap(spark):
    far, near = dt.date(2025, 1, 8), dt.date(2025, 1, 7)
    roles = lambda b: spark.createDataFrame([("a", DAY), ("b", b)], "role string, origin date")
    assert context.role_overlaps(roles(far)).count() == 0
    assert [r.target_date for r in context.role_overlaps(roles(near)).collect()] == [dt.date(2025, 1, 8)]


def test_bootstrap(spark):
    t = spark.createDataFrame([(DAY + dt.timedelta(i), 10.0, 4.0, 3.0) for i in range(5)], "origin date, volume double, ref double, cand double")
    r = select.bootstrap(t, 50).first()
    assert (r["mean"], r.low, r.high, r.p_positive) == (0.25, 0.25, 0.25, 1.0)
    assert select.bootstrap(t.limit(0), 50).first()["mean"] is None


def test_screening_keeps_the_control(spark):
    s = spark.createDataFrame([("c", 1.0, 1.0), ("x", 0.9985, 1.0), ("y", 0.5, 1.2)], "candidate string, aligned double, broad double")
    assert select.screened(s, F.col("candidate") == "c").first().candidate == "c"
    assert select.screened(s, F.col("candidate") == "c", least=0.001).first().candidate == "x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, DAY, 2.5), (2, DAY, float("nan"))], "product_id long, target_date date, pred double")
    assert [r.pred for r in sinks.json_safe(df).orderBy("product_id").collect()] == [2.5, None]
    sinks.write_submission(df.where("product_id = 1"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/parquet").first().quantity == 2
    a, b = (sinks.fingerprint(x, ["product_id", "pred"]).first() for x in (df, df.orderBy(F.desc("product_id"))))
    assert a == b and a != sinks.fingerprint(df.limit(1), ["product_id", "pred"]).first()
    folds = spark.createDataFrame([("2025-01-01", 1), ("2025-01-02", 2)], "origin string, x int")
    for o in ("2025-01-01", "2025-01-02"):
        sinks.write_folds(folds.where(F.col("origin") == o), f"{tmp_path}/oof")
    stored = spark.read.schema("x int, origin string").parquet(f"{tmp_path}/oof")
    assert stored.count() == 2 and sinks.missing_folds(folds, stored).count() == 0
