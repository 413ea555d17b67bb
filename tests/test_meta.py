"""Stacker, gates and selections against refits and plain readings."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside import catalog
from quayside.operators import candidates, selection
from quayside.operators.mixtures import known
from quayside.plans import meta

DIR = "/root/testdata/sf0.01"
MEMBERS = ["baseline", "seasonal_naive", "moving_avg"]


@pytest.fixture(scope="module")
def oof(spark):
    from quayside.sources.shared import written

    return written(catalog._oof(spark, DIR))


def test_stacker_equals_a_refit_without_the_origin(oof):
    got = meta.stacked(oof, MEMBERS, "baseline").toPandas()
    rows, names = meta.prepared(oof, MEMBERS)
    x = rows.toPandas()
    assert len(got) == len(x) > 300
    for o in sorted(x.origin.unique())[:3]:
        a, b = x[x.origin != o], x[x.origin == o]
        mean, sd = a[names].mean(), a[names].std(ddof=0).replace(0.0, 1.0)
        z, y = ((a[names] - mean) / sd).to_numpy(), (a.actual - a.pred_baseline).to_numpy()
        c = np.linalg.solve(z.T @ z + 100.0 * np.eye(len(names)), z.T @ (y - y.mean()))
        want = b[["product_id", "horizon"]].assign(want=np.maximum(b.pred_baseline + y.mean() + ((b[names] - mean) / sd).to_numpy() @ c, 0.0))
        both = want.merge(got[got.origin == o], on=["product_id", "horizon"])
        assert len(both) == len(b) and np.allclose(both.want, both.stacked, rtol=1e-8, atol=1e-8)


def test_stacker_of_one_origin_is_the_reference(oof):
    one = oof.where(F.col("origin") == oof.agg(F.max("origin")).first()[0])
    got = meta.stacked(one, MEMBERS, "baseline")
    assert got.count() > 0 and got.where(F.abs(F.col("stacked") - F.col("pred_baseline")) > 1e-9).count() == 0
    assert meta.stacked(oof.limit(0), MEMBERS, "baseline").count() == 0


def test_extra_columns_are_filled_by_their_median(oof):
    rows, names = meta.prepared(oof.withColumn("anomaly", F.when(F.col("horizon") > 3, F.col("horizon").cast("double"))), MEMBERS, ("anomaly",))
    r = rows.agg(F.min("x_anomaly"), F.sum("missing_anomaly"), F.count_if(F.col("horizon") <= 3)).first()
    assert "x_anomaly" in names and r[0] > 3 and r[1] == r[2] > 0


def gated(spark, n=360):
    """The specialist is far better on Mondays to Wednesdays, and worse on other days."""
    rng, rows = np.random.default_rng(0), []
    for i in range(n):
        origin, day = dt.date(2024, 1, 7) + dt.timedelta(7 * (i // 90)), i % 7
        actual = 100 + rng.normal() * 3
        good = (origin + dt.timedelta(day + 1)).weekday() < 3
        rows.append((i % 30, origin, day + 1, origin + dt.timedelta(day + 1), True, actual, actual + 40.0, actual + (2.0 if good else 90.0)))
    return spark.createDataFrame(rows, "product_id long, origin date, horizon int, target_date date, available boolean, actual double, pred_control double, pred_special double")


def test_the_gate_opens_where_the_specialist_is_better(spark):
    frame = gated(spark)
    got = meta.specialist_gate(frame, "control", "special", trees=12, step=0.3).toPandas()
    good = pd.to_datetime(got.target_date).dt.weekday < 3
    assert len(got) == 360 and got[good].alpha.mean() > 0.4 and got[~good].alpha.mean() < 0.05
    assert (got[good].blend - got[good].actual).abs().mean() < 25
    gain = (got.actual - got.pred_control).abs() - (got.actual - got.pred_special).abs()
    for o, own in got.groupby("origin"):
        other = gain[(got.origin != o) & (gain > 0)]
        assert own.scale.iloc[0] == pytest.approx(max(np.quantile(other, 0.75), 1.0)) and own.scale.nunique() == 1
    part = (got.predicted_advantage / got.scale).clip(0, 1) * 0.75
    assert np.allclose(part, got.alpha) and np.allclose(got.blend, np.maximum(got.pred_control + part * (got.pred_special - got.pred_control), 0))


def test_risk_gate_takes_the_bias_away(spark):
    frame = gated(spark)
    got = meta.risk_gate(frame, ["control", "special"], "control", trees=12, step=0.3).toPandas()
    assert (got.gated - got.actual).abs().mean() < 0.35 * (got.pred_control - got.actual).abs().mean()


def test_error_sums(oof):
    rng, rows = np.random.default_rng(1), known(oof, MEMBERS).withColumn("c", F.col("horizon") / 7.0)
    w = rng.dirichlet(np.ones(3), 17)
    got = {(r.origin, r.horizon, r.candidate): r for r in candidates.error_sums(rows, [f"pred_{m}" for m in MEMBERS], w, ["origin", "horizon"], "pred_baseline", "c", 50.0).collect()}
    x = rows.toPandas()
    for (o, h), g in list(x.groupby(["origin", "horizon"]))[:9]:
        p = np.maximum(g[[f"pred_{m}" for m in MEMBERS]].to_numpy() @ w.T, 0) - g.actual.to_numpy()[:, None]
        top = (g.actual >= 50).to_numpy()
        for i in range(17):
            r = got[(o, h, i)]
            want = [len(g), np.abs(p[:, i]).sum(), p[:, i].sum(), g.actual.abs().sum(), (g.pred_baseline - g.actual).abs().sum(), (g.c * np.abs(p[:, i])).sum(), np.abs(p[top, i]).sum()]
            assert [r[c] for c in ("n", "e", "b", "v", "r", "a", "te")] == pytest.approx(want)


def test_steps_of_weights():
    w = selection.weights_in_steps(3, 4)
    assert len(w) == math.comb(6, 2) and np.allclose(w.sum(axis=1), 1) and len({tuple(x) for x in w}) == len(w)


def test_diverse_members_in_the_order_of_a_plain_reading(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(600):
        y = float(rng.gamma(4, 20))
        e = rng.normal(size=4) * 12
        e = [float(v) for v in e]
        rows.append((i, dt.date(2024, 1, 7) + dt.timedelta(7 * (i % 5)), True, y, y + e[0], y + 0.9 * e[0] + 0.3 * e[1], y + 1.6 * e[2], y - e[0] + 0.5 * e[3], y + 30))
    names = ["ctl", "same", "other", "against", "bad"]
    frame = spark.createDataFrame(rows, "i long, origin date, available boolean, actual double, " + ", ".join(f"pred_{m} double" for m in names))
    families = {"ctl": "control", "same": "lag", "other": "lag", "against": "price", "bad": "statistical"}
    got = selection.diverse_members(frame, names, "ctl", families, 2, steps=4).toPandas()
    x = frame.toPandas()
    p, y, origins = x[[f"pred_{m}" for m in names]].to_numpy(), x.actual.to_numpy(), x.origin.to_numpy()
    cut, r = np.quantile(y, 0.9), np.abs(p[:, 0] - y)
    chosen, order = [0], []
    for _ in range(2):
        best = None
        for j in [k for k in range(5) if k not in chosen]:
            sub, made = [*chosen, j], np.zeros(len(y))
            grid = selection.weights_in_steps(len(sub), 4)
            for o in set(origins):
                fit, held = origins != o, origins == o
                k = int(np.argmin([np.abs(np.maximum(p[fit][:, sub] @ w, 0) - y[fit]).sum() for w in grid]))
                made[held] = np.maximum(p[held][:, sub] @ grid[k], 0)
            top = y >= cut
            gain, change = 1 - np.abs(made - y).sum() / r.sum(), np.abs(made - y)[top].sum() / r[top].sum() - 1
            corr = np.corrcoef(y - p[:, chosen].mean(axis=1), y - p[:, j])[0, 1] if names[j] != "bad" else 1.0
            score = gain - 0.12 * max(change, 0) + 0.04 * (1 - abs(corr))
            row = got[(got.step == len(order) + 1) & (got.candidate == names[j])].iloc[0]
            assert (row.improvement, row.correlation, row.score) == (pytest.approx(gain, abs=1e-9), pytest.approx(corr, abs=1e-6), pytest.approx(score, abs=1e-6))
            if best is None or score > best[0]:
                best = (score, j)
        chosen.append(best[1])
        order.append(names[best[1]])
    picked = got[got.chosen]
    assert order[0] == "against" and list(picked[picked.step > 0].sort_values("step").candidate) == order[:1]
    assert list(picked[picked.step == 0].candidate) == ["bad"]  # the anomaly family's place


def test_forward_groups_equal_separate_fits(spark):
    rng, n = np.random.default_rng(7), 900
    f = rng.normal(size=(n, 6))
    base = rng.gamma(5, 20, n)
    label = 0.05 * f[:, 0] + 0.5 * f[:, 1] + 0.3 * f[:, 3] + rng.normal(size=n) * 0.05
    origin = [dt.date(2024, 1, 7) + dt.timedelta(35 * (i % 6)) for i in range(n)]
    actual = np.expm1(np.log1p(base) + label)
    columns = [f"f{i}" for i in range(6)]
    frame = spark.createDataFrame([(origin[i], float(label[i]), 1.0 + i % 3, float(i % 400), float(actual[i]), float(base[i]), *map(float, f[i])) for i in range(n)], "origin date, label double, sample_weight double, age double, actual double, target_baseline double, " + ", ".join(f"{c} double" for c in columns))
    train, held = frame.where("age < 250"), frame.where("age >= 250")
    groups = {"a": ["f1", "f2"], "b": ["f3"], "c": ["f4", "f5"]}
    got = selection.forward_groups(train, held, ["f0"], groups, half_lives=(100.0,)).toPandas().set_index("label")
    a, b = train.toPandas(), held.toPandas()
    for label_, row in got.iterrows():
        use = ["f0", *[c for g in (row.groups.split("+") if row.groups else []) for c in groups[g]]]
        w = (a.sample_weight if not label_.startswith("half") else 2.0 ** (-a.age / 100.0)).to_numpy()
        mean, ybar = np.average(a[use], axis=0, weights=w), np.average(a.label, weights=w)
        sd = np.sqrt(np.average((a[use] - mean) ** 2, axis=0, weights=w))
        z = ((a[use] - mean) / sd).to_numpy()
        c = np.linalg.solve((z * w[:, None]).T @ z + 10.0 * np.eye(len(use)), (z * w[:, None]).T @ (a.label - ybar).to_numpy())
        p = np.maximum(np.expm1(np.log1p(b.target_baseline) + ybar + ((b[use] - mean) / sd).to_numpy() @ c), 0)
        assert row.broad == pytest.approx(np.abs(p - b.actual).sum() / b.actual.sum())
    chosen = got[got.selected]
    assert len(chosen) == 1 and {"a", "b"} <= set(chosen.groups.iloc[0].split("+")) and got.loc["control", "round"] == 0
    assert got.loc["single_a", "aligned"] < got.loc["control", "aligned"]
    with pytest.raises(ValueError):
        selection.forward_groups(train.limit(0), held, ["f0"], groups)
