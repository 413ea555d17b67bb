"""Product reports, errors in their context, splits, prepared windows; the anomaly layer knows nothing after its origin."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside import catalog
from quayside.operators import anomaly, report, windows
from quayside.plans import direct, walk
from quayside.sources.shared import written

DAY = dt.date(2024, 1, 1)
SCHEMA = "product_id long, date_key date, quantity double"


def day(i):
    return DAY + dt.timedelta(i)


def profile_of(spark, rows):
    """rows: product_id, day, quantity, score, flag, known_event."""
    df = spark.createDataFrame([(p, day(i), q, s, f, e) for p, i, q, s, f, e in rows], f"{SCHEMA}, score double, flag boolean, known_event boolean")
    return df.withColumns({c: F.lit(1.0) for c in report.TIMELINE if c not in df.columns} | {"systemic_flag": F.lit(None).cast("boolean"), "weight": F.lit(0.5)})


def test_a_report_ranks_flagged_days_and_keeps_products_without_a_future(spark):
    rows = [(1, 3, 5.0, 2.0, True, True), (1, 1, 4.0, 9.0, True, False), (1, 2, None, None, None, None), (1, 0, 1.0, 2.0, True, False), (1, 4, 1.0, 99.0, False, False), (2, 0, 1.0, None, False, False)]
    future = spark.createDataFrame([(1, day(6), True), (1, day(5), False), (3, day(5), True)], "product_id long, date_key date, is_promo boolean")
    got = {r.product_id: r for r in report.product_reports(profile_of(spark, rows), future, 2).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.observed_days, one.exceedances, one.on_events, one.max_score, one.mean_weight) == (4, 3, 1, 99.0, 0.5)
    assert [x.date_key for x in one.timeline] == [day(i) for i in range(5)] and not one.timeline[2].flag
    assert [x.date_key for x in one.top] == [day(1), day(0)]  # the tie goes to the earlier day
    assert [(x.date_key, x.is_promo) for x in one.future] == [(day(5), False), (day(6), True)]
    assert two.top == [] and two.future == [] and two.exceedances == 0
    assert report.product_reports(profile_of(spark, []), future).count() == 0


def test_an_error_meets_only_what_its_origin_knew(spark):
    values = {1: [10.0] * 7 + [20.0] * 7 + [999.0] * 5, 2: [10.0] * 14 + [5.0] * 5}
    values[1][3] = None
    state = spark.createDataFrame([(p, day(i), v) for p, q in values.items() for i, v in enumerate(q)], SCHEMA)
    errors = spark.createDataFrame([(1, day(13), 1, 15.0), (1, day(13), 2, None), (1, day(2), 1, 15.0), (9, day(13), 1, 1.0)], "product_id long, origin date, horizon int, actual double")
    got = {(r.product_id, r.origin, r.horizon): r for r in report.error_context(errors, state).collect()}
    a = got[1, day(13), 1]
    assert a.product_lift == pytest.approx(1.0) and a.actual_percentile == pytest.approx(6 / 13)
    assert a.portfolio_lift == pytest.approx(30 / ((20 * 6 + 10) / 7) - 1)
    assert got[1, day(13), 2].actual_percentile is None and got[1, day(13), 2].product_lift == pytest.approx(1.0)
    early = got[1, day(2), 1]
    assert early.product_lift is None and early.portfolio_lift is None and early.actual_percentile == 1.0
    assert got[9, day(13), 1].product_lift is None and got[9, day(13), 1].portfolio_lift == a.portfolio_lift


def twin(n, holdout, calibration, fraction, least, training):
    """Places of n consecutive days by split."""
    at = list(range(n))
    h = [i for i in at if n - 1 - i < holdout]
    c = [i for i in at if holdout <= n - 1 - i < holdout + calibration]
    pool = [i for i in at if n - 1 - i >= holdout + calibration and (training is None or n - 1 - i < holdout + calibration + training)]
    if len(pool) < max(20, least) or len(c) < 20 or len(h) < 20:
        end = min(max(20, least, int(n * 0.65)), n - 40)
        stop = min(max(end + 20, int(n * 0.85)), n - 20)
        pool, c, h = at[:end], at[end:stop], at[stop:]
    v = min(max(12, round(len(pool) * fraction)), max(1, len(pool) // 3))
    return {"train": pool[:-v], "validation": pool[-v:], "calibration": c, "holdout": h}


@pytest.mark.parametrize("n, more", [(400, {"holdout_days": 60, "calibration_days": 50, "least": 40, "training_days": 200}), (1600, {}), (150, {"least": 40}), (60, {"least": 10}), (300, {"holdout_days": 30, "calibration_days": 30, "training_days": None})])
def test_splits(spark, n, more):
    days = spark.createDataFrame([(day(i),) for i in range(n)], "date_key date").repartition(3)
    got = report.temporal_split(days, **more).collect()
    by = {}
    for r in got:
        by.setdefault(r.split, []).append((r.date_key - DAY).days)
    own = {"holdout_days": 180, "calibration_days": 180, "validation_fraction": 0.15, "least": 120, "training_days": 1095} | more
    want = twin(n, *[own[k] for k in ("holdout_days", "calibration_days", "validation_fraction", "least", "training_days")])
    assert len(got) == n and {k: sorted(v) for k, v in by.items() if k != "ignored"} == want


def test_splits_that_cannot_be(spark):
    days = spark.createDataFrame([(day(i),) for i in range(59)], "date_key date")
    with pytest.raises(ValueError, match="59 days"):
        report.temporal_split(days)
    with pytest.raises(ValueError, match="validation_fraction"):
        report.temporal_split(days, validation_fraction=0.5)
    with pytest.raises(ValueError, match="left to train"):
        report.temporal_split(days.unionByName(spark.createDataFrame([(day(60),)], days.schema)), least=120)


def test_windows_are_prepared_by_training_points_alone(spark):
    rng = np.random.default_rng(4)
    raw = rng.normal(5.0, 3.0, (40, 3))
    raw[rng.random((40, 3)) < 0.1] = np.nan
    raw[35, 0], raw[:, 2] = 1e6, np.nan
    wide, last = 5, 25
    rows = [(day(i), [[None if math.isnan(x) else float(x) for x in raw[k]] for k in range(i - wide + 1, i + 1)]) for i in range(wide - 1, 40)]
    got = {r.date_key: np.array(r.window) for r in report.prepared_windows(spark.createDataFrame(rows, "date_key date, window array<array<double>>"), str(day(last))).collect()}
    points = np.concatenate([raw[i - wide + 1 : i + 1] for i in range(wide - 1, last + 1)])
    with np.errstate(all="ignore"):
        middle = np.array([np.nanmedian(points[:, 0]), np.nanmedian(points[:, 1]), 0.0])
    filled = np.where(np.isnan(points), middle, points)
    sd = filled.std(axis=0)
    z = np.clip((np.where(np.isnan(raw), middle, raw) - filled.mean(axis=0)) / np.where(sd > 1e-6, sd, 1.0), -8, 8)
    for i in range(wide - 1, 40):
        assert got[day(i)] == pytest.approx(z[i - wide + 1 : i + 1])
    assert got[day(39)].max() == 8.0
    with pytest.raises(ValueError, match="no window"):
        report.prepared_windows(spark.createDataFrame(rows, "date_key date, window array<array<double>>"), "2000-01-01")


CUTOFF = "1999-09-12"


@pytest.fixture(scope="module")
def state(spark):
    return written(windows.with_state(catalog._filled(spark, "/root/testdata/sf0.01")).where("product_id <= 3 and date_key >= DATE '1997-06-01'"))


def predictions(df):
    return {(r.product_id, r.horizon): r.pred for r in df.collect()}


def test_the_layer_knows_nothing_after_its_origin(state):
    later = F.col("date_key") > F.lit(CUTOFF).cast("date")
    changed = state.withColumns({c: F.when(later, F.col(c) * 50 + 7).otherwise(F.col(c)) for c in ("quantity", "qty_available", "quantity_app", "quantity_web")})
    a, b = (predictions(walk.layered_strategy(written(s), "ridge")(CUTOFF)) for s in (state, changed))
    near = {k for k in a if k[1] == 1}  # a further target's seasons never reach beyond the origin either, in a week
    assert len(near) == 3 and set(a) == set(b)
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_modes_of_the_layer(state):
    plain = predictions(walk.direct_strategy(written(direct.direct_panel(state)), "ridge")(CUTOFF))
    off, weight, both = (predictions(walk.layered_strategy(state, "ridge", mode=m)(CUTOFF)) for m in ("off", "weight", "both"))
    assert set(off) == set(weight) == set(both) == set(plain)
    assert all(off[k] == pytest.approx(plain[k]) for k in plain)
    assert any(abs(weight[k] - off[k]) > 1e-6 for k in off) and any(abs(both[k] - weight[k]) > 1e-6 for k in off)
    with pytest.raises(ValueError, match="no such anomaly layer"):
        walk.layered_strategy(state, "ridge", mode="none")(CUTOFF)


def test_weights_come_from_past_days(state):
    """The rows that are fitted on have weights of mean 1, less where the target day stood out."""
    past = state.where(F.col("date_key") <= F.lit(CUTOFF).cast("date"))
    prof = written(anomaly.profile(past))
    fit_on = lambda rows, keep: direct.recency_weights(direct.trainable(direct.direct_panel(rows, 1, keep=keep), CUTOFF), CUTOFF, None)
    train = anomaly.anomaly_layer(past, fit_on, prof, mode="weight")
    r = train.agg(F.avg("sample_weight").alias("mean"), F.avg(F.when(F.col("target_flag"), F.col("sample_weight"))).alias("flagged"), F.max("target_date").alias("last")).first()
    assert r.mean == pytest.approx(1) and r.flagged < 0.9 and str(r.last) <= CUTOFF
