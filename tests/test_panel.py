"""Exact values of panel operators, and registered queries against their SQL on the smallest tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quayside import catalog
from quayside.functions import scalar
from quayside.operators import anomaly, windows
from quayside.plans import direct, evaluate
from quayside.sources import panel as source

RAW = "product_id long, date_key date, available boolean, quantity_app double, quantity_web double, quantity double, is_promo boolean, campaign_web int, campaign_app int, discount_web double, discount_app double, price double"
DAY = dt.date(2025, 1, 1)


def ramp(spark, n=40, skip=(), off=(), products=(1,)):
    rows = [(p, DAY + dt.timedelta(i - 1), i not in off, 0.0, float(i), float(i), False, -1, -1, 0.0, 0.0, 100.0) for p in products for i in range(1, n + 1) if i not in skip]
    return windows.with_state(source.fill_calendar(spark.createDataFrame(rows, RAW)))


def test_panel_of_a_ramp(spark):
    rows = {(r.origin, r.horizon): r for r in direct.direct_panel(ramp(spark)).collect()}
    r = rows[(DAY + dt.timedelta(29), 3)]
    assert (r.target, r.season_7, r.season_28, r.lag_0, r.target_date) == (33.0, 26.0, 5.0, 30.0, DAY + dt.timedelta(32))
    assert r.target_baseline == pytest.approx((4 * 26 + 3 * 19 + 2 * 12 + 5) / 10)

    with pytest.raises(ValueError):
        direct.direct_panel(ramp(spark), 8)


def test_gap_is_not_zero(spark):
    rows = {r.date_key: r for r in ramp(spark, skip=(10,), off=(11,)).collect()}
    gap, off = rows[DAY + dt.timedelta(9)], rows[DAY + dt.timedelta(10)]
    assert (gap.is_gap, gap.quantity, gap.observed, gap.is_unavailable, gap.price) == (True, None, 0, 0, 100.0)
    assert (off.is_gap, off.qty_available, off.observed, off.is_unavailable) == (False, None, 1, 1)


def test_lifecycle(spark):
    rows = {r.date_key: r for r in windows.lifecycle(ramp(spark, off=(5, 6, 7))).collect()}
    assert [rows[DAY + dt.timedelta(i)].unavailable_streak for i in range(3, 8)] == [0, 1, 2, 3, 0]
    assert rows[DAY + dt.timedelta(7)].returned and rows[DAY + dt.timedelta(6)].days_since_available == 3


def test_later_days_do_not_change_earlier_scores(spark):
    state = ramp(spark, 120)
    other = state.withColumn("qty_available", F.when(F.col("date_key") > DAY + dt.timedelta(100), 999.0).otherwise(F.col("qty_available")))
    early = lambda df: anomaly.scores(df).where(F.col("date_key") <= DAY + dt.timedelta(100)).select("date_key", "score").orderBy("date_key").collect()
    assert early(state) == early(other)


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 1.0), (None, 5.0), (5.0, None)], "actual double, pred double")
    r = df.agg(*evaluate.metrics()).first()
    assert (r.n, r.mae, r.wape, r.bias, r.bias_ratio) == (2, 1.5, 0.3, -0.5, -0.1) and r.mape == pytest.approx(60.0)


def test_weights_have_mean_one(spark):
    p = direct.recency_weights(direct.direct_panel(ramp(spark)), "2025-02-09", 10)
    assert p.agg(F.avg("sample_weight")).first()[0] == pytest.approx(1)


def test_checks(spark):
    with pytest.raises(ValueError):
        source.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(ValueError):
        source.sanitize_future(spark.createDataFrame([(1,)], "product_id long"))
    assert source.read_artefact(spark, "/tmp/none-such.csv", "a int").count() == 0


def test_stratum(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 10),), (dt.date(2025, 11, 13),), (dt.date(2025, 11, 12),), (dt.date(2025, 2, 22),)], "o date")
    assert [r.s for r in df.select(scalar.stratum(F.col("o")).alias("s")).collect()] == ["winter", "holiday", "regular", "regular"]


CHEAP = ["src1_sales_panel", "src2_epoch_dates", "src4_future_covariates", "jn14_duplicate_keys", "agg1_2_reference_dates", "prj2_3_4_events", "prj17_18_submission_strata", "win3_4_lags", "pnl11_12_agg6_baseline_wape", "agg13_test_aligned", "pnl15_jn7_final_naive", "pnl8_step_panel"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    import math
    from pathlib import Path

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)
    key = lambda row: tuple(map(str, row))
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
