"""Daily evidence, further choices, models and report tables on small frames with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.operators import audit, select
from quayside.plans import models
from quayside.sources import sinks

DAY = dt.date(2025, 1, 1)
ENDS = ("2025-01-02", "2025-01-04", "2025-01-14")


def daily(spark, scores, events=()):
    rows = [(DAY + dt.timedelta(i), i in events, v) for i, v in enumerate(scores)]
    df = spark.createDataFrame(rows, "date_key date, known_event boolean, score double")
    return audit.daily_scores(df, ENDS)


def test_holdout_state(spark):
    got = audit.holdout_state(daily(spark, [1.0] * 14 + [1.0, 9.0, 9.0], {16})).orderBy("date_key").collect()
    assert [r.weight for r in got[:14]] == [None] * 14 and got[14].weight == 1.0 and not got[14].flag
    assert got[15].flag and got[15].weight < 1e-9 and got[16].weight == 0.65
    assert audit.holdout_state(daily(spark, [])).count() == 0


def test_integrity(spark):
    good = daily(spark, [1.0, None, 2.0])
    assert audit.integrity(good).first()[1:] == (0, 0, 0, 0)
    bad = good.unionByName(good.limit(1)).unionByName(good.limit(1).withColumns({"score": F.lit(-1.0), "split": F.lit("holdout")}))
    r = audit.integrity(bad).first()
    assert (r.n_days, r.repeated_dates, r.bad_scores) == (5, 2, 1)
    assert audit.integrity(good.limit(0)).first().n_days == 0


def test_mean_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted(r.r for r in df.select(audit.mean_rank("x").alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_choices(spark):
    s = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 2.0), ("c", "g", 3.0), ("d", "g", 4.0)], "candidate string, family string, aligned double")
    assert {r.candidate for r in select.family_top(s, 1, F.col("candidate") == "d").collect()} == {"a", "c", "d"}
    runs = s.withColumns({"cost": F.lit(5) - F.col("aligned"), "q": 1 + F.col("aligned") / 100})
    assert select.cheapest_within(runs, "q", "cost", 0.0101).first().candidate == "b"
    rows = spark.createDataFrame([("m", "x", 0.5), ("m", "y", 0.4), ("n", "x", None)], "model string, strategy string, wape double")
    assert [tuple(r) for r in select.best_strategy(rows).select("model", "strategy", "rank").collect()] == [("m", "y", 1)]
    plan = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5), ("t", "z", 1.0), ("u", "a", 0.7)], "scope string, member string, weight double")
    assert {r.scope: r.valid for r in select.check_plan(plan, ["a", "b"]).collect()} == {"s": True, "t": False, "u": False}


def test_origins(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(11)], "date_key date")
    assert [r.date_key.day for r in select.even_origins(days, 3).orderBy("date_key").collect()] == [1, 6, 11]
    assert select.even_origins(days, 50).count() == 11
    assert [r.origin for r in select.recent_origins(days, 2).orderBy("origin").collect()] == [dt.date(2024, 12, 28), dt.date(2025, 1, 4)]
    assert select.recent_origins(days.limit(0), 2).count() == 0


def test_report_tables(spark):
    f = spark.createDataFrame([(1, 2.5, None)], "product_id long, pred_a double, pred_b double")
    assert {(r.model, r.quantity) for r in sinks.forecast_table(f, ["product_id"], ["a", "b"]).collect()} == {("a", 2), ("b", None)}
    d = spark.createDataFrame([(1, DAY + dt.timedelta(i), float(i)) for i in range(5)], "product_id long, date_key date, quantity double")
    assert [x.quantity for x in sinks.payload(d, 2).first().history] == [3.0, 4.0]
    b = sinks.boundary(d, "2025-01-04", ["product_id"]).first()
    assert (b.last, b.left_out, b.n_rows) == (dt.date(2025, 1, 3), 2, 3)


def test_ridge_learns_a_scale(spark):
    rows = [(1, DAY + dt.timedelta(i), 1 + i % 7, 2.0 * (10 + i % 5), float(10 + i % 5), 1.0) for i in range(60)]
    p = spark.createDataFrame(rows, "product_id long, target_date date, horizon int, target double, target_baseline double, sample_weight double")
    p = p.withColumns({c: F.col("target_baseline") for c in models.NUMERIC if c not in ("target_baseline", "annual")} | {"annual": F.when(F.col("horizon") > 2, F.lit(3.0))})
    got = models.fit_predict(p, p, "ridge").collect()
    assert len(got) == 60 and all(r.pred == pytest.approx(r.target, rel=0.05) for r in got)
    with pytest.raises(ValueError):
        models.fit_predict(p.limit(0), p, "ridge")
