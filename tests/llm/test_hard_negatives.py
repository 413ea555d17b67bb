"""Hard negatives against a plain reading, and Strassen's products against the usual ones."""

import math

import numpy as np
import pytest

from quayside.llm import hard_negatives as hn


@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (5, 7, 3), (33, 17, 65), (64, 64, 64), (100, 31, 130)])
def test_strassen_is_the_product_modulo_2_64(n, k, m):
    rng = np.random.default_rng(n)
    small, large = rng.integers(-500, 500, (n, k)), rng.integers(-(1 << 62), 1 << 62, (n, k))
    b = rng.integers(-(1 << 62), 1 << 62, (k, m))
    assert (hn.strassen(small, b, 4) == small @ b).all() and (hn.strassen(large, b, 2) == large @ b).all()


def test_products_of_any_size():
    a, b = np.array([[1e300, 2.0], [2.0**40, -3.0], [5.0, 7.0]]), np.array([[1.0, 1e300], [-(2.0**40), 2.0], [-4.0, 6.0]])
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(r, c)), hn.LEAST), hn.MOST) for c in b] for r in a]
    assert hn.products(a, b).tolist() == want


def brute(rows, k=10):
    ok = [(i, x, [math.floor(256 * float(c)) for c in v]) for i, v, x in rows if i is not None and x is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, v in ok:
        if a % 100:
            continue
        scored = [(-min(max(sum(p * q for p, q in zip(v, w)), hn.LEAST), hn.MOST), i, x) for i, x, w in ok if i != a and len(w) == len(v)]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted((s, j) for s, j, x in scored if x != label and 30 * -p <= 100 * -s <= 90 * -p)[:k]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label long, number int, rank string")


def test_mines_as_a_plain_reading_does(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE", 3)
    monkeypatch.setattr(hn, "TILE_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).round(1).tolist(), int(rng.integers(0, 4))) for i in range(1200)]
    rows += [(5000 + i, rows[7][1], 1) for i in range(40)]  # ties by copies
    rows += [(300, rows[9][1], 2), (11, rows[9][1], 2)]  # repeated ids
    rows += [(6000, None, 1), (6100, [1.0] * 12, None), (6200, [float("nan")] * 12, 1), (6300, [None] * 12, 1), (6400, [], 1), (None, [1.0] * 12, 1), (6500, [1.0] * 3, 1), (6600, [float("inf")] * 12, 2)]
    rows += [(7000, [1e200] + [0.5] * 11, 1), (7001, [1e200] + [0.25] * 11, 1), (7002, [3.0] * 12, 2)]
    df = table(spark, rows).repartition(3)
    got = hn.mine(df, df.where("vec_id % 100 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_every_pile_of_anchors_is_mined(spark, monkeypatch):
    monkeypatch.setattr(hn, "PILE_BYTES", 1000)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), int(rng.integers(0, 3))) for i in range(900)]
    df = table(spark, rows)
    assert sorted(tuple(r) for r in hn.mine(df, df.where("vec_id % 100 = 0")).collect()) == brute(rows)


def test_empty_table_gives_no_rows(spark):
    df = table(spark, [(1, [1.0], 1)]).limit(0)
    assert hn.mine(df, df).collect() == []


def test_window_is_exact_at_the_ends_of_a_long():
    p = np.array([0, 1, 99, -7, 101, hn.MOST, hn.LEAST])
    low, high = hn.window(p, 30, 90)
    for x, a, z in zip(p.tolist(), low.tolist(), high.tolist()):
        assert a == -(-30 * x // 100) and z == 90 * x // 100
