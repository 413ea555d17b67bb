"""Context risk: planted outliers first, trees and percentiles as a plain reading has them."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.functions.quantiles import share_at_or_below
from quayside.operators import forest

SCHEMA = "product_id long, date_key date, price double, discount_web double, discount_app double, campaign_web int, campaign_app int, is_promo boolean, extra string"


def rows(n=1500, seed=3):
    rng = random.Random(seed)
    return [(i % 5, dt.date(2024, 1, 1) + dt.timedelta(i // 5), rng.gauss(100, 5), rng.choice([0.0, 10.0]), rng.choice([0.0, 12.0]), rng.choice([-1, 0, 1]), rng.choice([-1, 2]), rng.random() < 0.2, "x") for i in range(n)]


ODD = [
    (1, dt.date(2024, 10, 28), 900.0, 80.0, 75.0, 19, 18, True, "odd"),
    (2, dt.date(2024, 10, 28), -40.0, 0.0, 0.0, -1, 2, False, "odd"),
    (77, dt.date(2024, 10, 28), 100.0, 95.0, 0.0, 16, None, None, "odd"),
]


def test_planted_outliers_rank_first(spark):
    risk = forest.fit(spark.createDataFrame(rows(), SCHEMA), trees=60, sample=256)
    new = [(*r[:-1], "usual") for r in rows(100, 9)]
    got = risk.score(spark.createDataFrame(new + ODD, SCHEMA)).orderBy(F.desc("context_risk_raw")).collect()
    assert len(got) == 103 and {r.extra for r in got[:3]} == {"odd"}
    assert all(r.context_shift_flag and r.context_risk_percentile == 1.0 for r in got[:3])
    assert np.mean([r.context_shift_flag for r in got[3:]]) < 0.1
    usual = [r.context_risk_percentile for r in got[3:]]
    assert 0.3 < np.mean(usual) < 0.7


def test_the_same_rows_give_the_same_trees(spark):
    df = spark.createDataFrame(rows(200), SCHEMA).coalesce(1)
    a, b = (forest.fit(df, trees=5, sample=64).forest.trees for _ in range(2))
    assert [t["feature"] for t in a] == [t["feature"] for t in b] and [t["n"] for t in a] == [64] * 5


def test_a_forest_scores_by_its_paths():
    rng = np.random.default_rng(0)
    x, texts = rng.normal(size=(200, 3)), [rng.choice(["a", "b", "c"], 200), rng.choice(["u", "v"], 200)]
    trees = [{"tree": i, "n": 200, **forest.grow(x, texts, np.random.default_rng(i))} for i in range(7)]
    f = forest.Forest(trees, 3)
    new, new_texts = rng.normal(size=(50, 3)) * 2, [rng.choice(["a", "b", "never"], 50), rng.choice(["u", "v"], 50)]
    got = f.score(new, [pa.array(t.tolist()) for t in new_texts])
    for i in range(50):
        total = 0
        for t in trees:
            at = 0
            while t["feature"][at] >= 0:
                j = t["feature"][at]
                left = new[i, j] <= t["threshold"][at] if j < 3 else new_texts[j - 3][i] == t["category"][at]
                at = t["left"][at] if left else t["right"][at]
            total += t["length"][at]
        c = 2 * (math.log(199) + np.euler_gamma) - 2 * 199 / 200
        assert got[i] == pytest.approx(2 ** (-total / 7 / c))


def test_every_row_of_a_tree_reaches_a_leaf_of_its_size():
    x = np.arange(64.0).reshape(-1, 1)
    t = forest.grow(x, [], np.random.default_rng(1))
    assert max(t["length"]) <= 6 + forest.path_correction(64) and t["feature"].count(-1) == len(t["feature"]) // 2 + 1
    same = forest.grow(np.ones((5, 2)), [np.array(["a"] * 5)], np.random.default_rng(1))
    assert same["feature"] == [-1] and same["length"] == [forest.path_correction(5)]


def test_missing_columns_nulls_and_no_rows(spark):
    few = spark.createDataFrame([(1, dt.date(2024, 1, 1), None, None), (2, dt.date(2024, 1, 2), 3.0, None), (None, dt.date(2024, 1, 3), float("nan"), None)], "product_id long, date_key date, price double, discount_web double")
    risk = forest.fit(few, trees=3)
    got = risk.score(few).collect()
    assert len(got) == 3 and all(r.context_risk_raw is not None and not math.isnan(r.context_risk_raw) for r in got)
    assert risk.score(few.limit(0)).count() == 0
    with pytest.raises(ValueError):
        forest.fit(few.limit(0))


def test_share_at_or_below(spark):
    rng = random.Random(1)
    ref, own = [rng.randrange(40) / 1.0 for _ in range(500)] + [None], [(i, rng.randrange(-5, 50) / 1.0) for i in range(200)] + [(900, None)]
    a, b = spark.createDataFrame([(v,) for v in ref], "v double").repartition(3), spark.createDataFrame(own, "i long, v double").repartition(3)
    known = [v for v in ref if v is not None]
    got = {r.i: r.share for r in share_at_or_below(b, a, "v", "share").collect()}
    assert got == {i: None if v is None else pytest.approx(sum(x <= v for x in known) / 500) for i, v in own}
    assert {r.share for r in share_at_or_below(b, a.limit(0), "v", "share").collect()} == {None}
