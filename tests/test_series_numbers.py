"""Series are numbered from 1 without gaps in ascending order, however they are spread."""

import random

import pytest

from quayside.sources import panel


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 4), (3, 8), (5000, 7)])
def test_numbers_follow_the_order(spark, n, parts):
    names = [f"s{i * 37 % 10007}|ä{i % 3}" for i in range(n)] + ([""] if n else [])
    rows = [(x,) for x in names for _ in range(2)]
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame(rows, "series string").repartition(parts)
    got = {r.series: r.product_id for r in panel.series_numbers(df).collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(names), key=lambda x: x.encode()), 1)}


def test_one_prefix_spreads_over_partitions(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("concat('the same long beginning of all ', lpad(id, 6, '0')) AS series")
    got = panel.series_numbers(df)
    assert got.selectExpr("max(product_id) = 4000 AND min(product_id) = 1 AND count(DISTINCT product_id) = 4000").first()[0]
    assert got.join(df.selectExpr("series", "cast(right(series, 6) as long) + 1 AS want"), "series").where("product_id <> want").count() == 0
