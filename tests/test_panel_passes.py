"""Fits and forecasts pass over a written panel: the state that is made from lineitem is computed once a query."""

import pytest

import __spark_entry__
from quayside import catalog

DIR = "/root/testdata/sf0.001"


def passes(spark, monkeypatch, name):
    """Rows of the state that a query computes, and rows that the state has."""
    seen, real = spark.sparkContext.accumulator(0), catalog._state

    def state(s, d):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = real(s, d)
        return df.mapInArrow(count, df.schema)

    n = real(spark, DIR).count()
    monkeypatch.setattr(catalog, "_state", state)
    assert __spark_entry__.queries()[name](spark, DIR).collect()
    return seen.value, n


@pytest.mark.parametrize("name", ["pnl5_mdl1_ridge_by_origin", "pnl13_final_ridge", "mdl7_app_share"])
def test_walks_and_final_fits_read_the_state_once(spark, monkeypatch, name):
    made, n = passes(spark, monkeypatch, name)
    assert made == n


def test_fits_at_a_cutoff_read_the_state_once(spark, monkeypatch):
    made, n = passes(spark, monkeypatch, "mdl6_huber")
    assert made == n
