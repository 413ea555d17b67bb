"""Models on category domains and ids, stored walk-forward runs, recursion from many origins."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside import catalog
from quayside.operators import windows
from quayside.plans import direct, models, recursive, walk
from quayside.sources.shared import written

DIR = "/root/testdata/sf0.01"
CUTOFF = "2000-12-03"


@pytest.fixture(scope="module")
def state(spark):
    return written(windows.with_state(catalog._filled(spark, DIR)).where("product_id <= 4"))


@pytest.fixture(scope="module")
def panel(state):
    return written(direct.direct_panel(state))


def weighted(panel, cutoff=CUTOFF):
    return direct.recency_weights(direct.trainable(panel, cutoff), cutoff, 365.0)


def test_codes_are_the_same_in_every_frame(spark):
    domains = (("campaign_web", (-1, 0, 16)),)
    df = spark.createDataFrame([(-1,), (16,), (99,), (None,)], "campaign_web int")
    got = models.coded(df, domains)
    assert [r.d_campaign_web for r in got.collect()] == [0.0, 2.0, 3.0, 3.0]
    assert got.schema["d_campaign_web"].metadata["ml_attr"]["vals"] == ["-1", "0", "16", "other"]


def test_trees_split_on_categories_and_take_unseen_codes(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 6), dt.date(2024, 1, 1) + dt.timedelta(int(i // 6)), 1 + int(i % 7), 50.0 if i % 6 in (1, 4) else 10.0, 20.0, 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "product_id long, target_date date, horizon int, target double, target_baseline double, sample_weight double")
    fitted = models.fit_model(df, "trees_a", trees=3, inputs=models.CATEGORICAL)
    place = len(models.CATEGORICAL.numbers) * 2 + 3  # product_code
    assert f"feature {place} in {{" in fitted.models[42].toDebugString
    new = df.limit(12).withColumn("product_id", F.when(F.col("product_id") == 1, 63).otherwise(F.col("product_id")))
    got = fitted.predict(new).collect()
    assert len(got) == 12 and all(r.pred is not None for r in got)
    by = {r.product_id: r.pred for r in got}
    assert by[4] > by[0] + 1


def test_a_column_without_any_value_is_filled_with_0(panel):
    train = weighted(panel.withColumn("annual", F.lit(None).cast("double")))
    for kind in ("ridge", "trees_a"):
        made = models.fit_predict(train, panel.where(F.col("origin") == F.lit(CUTOFF).cast("date")), kind, 2)
        assert made.where("pred is null").count() == 0 and made.count() > 0


def test_products_that_differ_only_in_id_get_different_forecasts(spark):
    day = dt.date(2024, 1, 1)
    rows = [(p, day + dt.timedelta(i % 50), 1 + i % 7, (10.0, 40.0)[p - 1], 20.0, -1, -1, 1.0) for p in (1, 2) for i in range(350)]
    df = spark.createDataFrame(rows, "product_id long, target_date date, horizon int, target double, target_baseline double, campaign_web int, campaign_app int, sample_weight double")
    got = models.fit_predict(df, df.where(f"horizon = 3 and target_date = DATE '{day + dt.timedelta(2)}'").dropDuplicates(["product_id"]), "factor", seeds=(42, 43, 44)).collect()
    by = {r.product_id: r.pred for r in got}
    assert len(by) == 2 and by[2] > by[1] * 1.3


def test_a_wide_panel_has_all_groups(state):
    panel = models.wide_panel(state, origins=["2000-06-04", CUTOFF])
    made = models.features(panel, models.WIDE)
    known = made.agg(*[F.count(f"x_{c}").alias(c) for c in models.WIDE.numbers]).first().asDict()
    assert all(known[c] > 0 for c in ("demand_mean_28", "price", "promo", "black_friday_days", "unavailable_streak", "price_vs_median_28")), known
    train = weighted(models.wide_panel(state.where("date_key >= DATE '2000-01-01'")))
    assert models.fit_predict(train, panel.where(F.col("origin") == F.lit(CUTOFF).cast("date")), "ridge", inputs=models.WIDE).where("pred is null").count() == 0


class Broken(Exception):
    pass


def test_a_broken_run_goes_on_and_equals_a_whole_one(spark, panel):
    origins = ["1999-02-07", "1999-09-12", "2000-12-03"]
    wanted = spark.createDataFrame([("direct", "validation" if i else "benchmark", dt.date.fromisoformat(o)) for i, o in enumerate(origins)], "strategy string, origin_type string, origin date")
    whole, part = tempfile.mkdtemp(prefix="walk-"), tempfile.mkdtemp(prefix="walk-")
    made = walk.direct_strategy(panel, "ridge")
    want = walk.walk_stored(wanted, {"direct": made}, whole)
    calls = []

    def fails_at_second(origin):
        calls.append(origin)
        if len(calls) == 2:
            raise Broken
        return made(origin)

    with pytest.raises(Broken):
        walk.walk_stored(wanted, {"direct": fails_at_second}, part)
    assert [str(r.origin) for r in walk.missing_jobs(wanted, part).orderBy("origin").collect()] == origins[1:]
    got = walk.walk_stored(wanted, {"direct": fails_at_second}, part)
    assert calls == [origins[0], origins[1], origins[1], origins[2]]
    again = walk.walk_stored(wanted, {"direct": fails_at_second}, part)
    assert len(calls) == 4
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df.select(*columns).withColumn("pred", F.round("pred", 6)).collect()))
    assert rows(got) == rows(want) == rows(again) and want.count() > 50
    assert walk.stored_folds(wanted.where("origin_type = 'benchmark'"), part).select("origin").distinct().count() == 1


def test_a_fold_made_twice_is_stored_once_and_one_without_rows_is_done(spark):
    path = tempfile.mkdtemp(prefix="walk-")
    wanted = spark.createDataFrame([("s", "t", dt.date(2024, 1, 1)), ("s", "t", dt.date(2024, 1, 8))], "strategy string, origin_type string, origin date")
    df = spark.createDataFrame([(1, 2.0)], "product_id long, pred double")
    walk.walk_stored(wanted.limit(1), {"s": lambda o: df}, path)
    rows = df.withColumns({"strategy": F.lit("s"), "origin_type": F.lit("t"), "origin": F.lit("2024-01-08")})  # a run that ended before its entry
    rows.write.mode("append").partitionBy(*walk.FOLD).parquet(f"{path}/rows")
    assert walk.walk_stored(wanted, {"s": lambda o: df}, path).count() == 2
    more = spark.createDataFrame([("s", "t", dt.date(2024, 1, 15))], wanted.schema)
    assert walk.walk_stored(more, {"s": lambda o: df.limit(0)}, path).count() == 0 and walk.missing_jobs(more, path).count() == 0


def test_recursion_from_many_origins_equals_one_by_one(spark, state):
    origins = ["2000-06-04", "2000-12-03"]
    predict = walk.fitted_steps(state, origins, "ridge")
    got = walk.forecast_origins(state, origins, predict, 3)
    columns = ["product_id", "origin", "horizon", "target_date", "pred", "fallback_used"]
    rows = lambda df: sorted(map(str, df.select(*columns).withColumn("pred", F.round("pred", 6)).collect()))
    want = []
    for o in origins:
        day = F.lit(o).cast("date")
        history = state.where(F.col("date_key") <= day)
        live = history.where(F.col("date_key") == day).select("product_id")
        ahead = state.where(F.col("date_key").between(F.date_add(day, 1), F.date_add(day, 3))).join(live, "product_id", "left_semi")
        one = recursive.forecast_with(history.join(live, "product_id", "left_semi"), ahead, lambda p, day=day: predict(p.withColumn("first_origin", day)).drop("first_origin"), 3)
        want += rows(one)
    assert rows(got) == sorted(want) and len(want) > 20


def test_guards_fire_for_a_wild_step(state):
    wild = lambda p: p.withColumn("pred", F.when(F.col("product_id") == 1, F.lit(float("inf"))).otherwise(1e9))
    got = walk.forecast_origins(state, [CUTOFF], wild, 2).collect()
    assert got and all(r.fallback_used and r.pred < 1e4 for r in got) and {r.nonfinite for r in got} == {True, False}
