"""Every registered query of the panel library that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from quayside import catalog, catalog_context, catalog_decisions, catalog_evidence, catalog_mixtures, catalog_models, catalog_reports, catalog_strategies

DIR = "/root/testdata/sf0.001"
PARTS = [catalog, catalog_context, catalog_decisions, catalog_evidence, catalog_mixtures, catalog_models, catalog_reports, catalog_strategies]
#: 430,000 rows, which a test need not sort: its columns stand in set1_pnl2_future_panel as well.
LARGE = {"pnl2_win6_12_21_direct_panel"}
QUERIES = {k: v for p in PARTS for k, v in p.queries().items()}
SQL = {k: v for p in PARTS for k, v in p.oracle_sql().items()}


@pytest.fixture(scope="module", autouse=True)
def tables_once():
    """The panel's tables are built once for all queries."""
    from quayside.sources.shared import written

    with pytest.MonkeyPatch.context() as patch:
        for name in ("_panel", "_filled", "_state", "_oof"):
            patch.setattr(catalog, name, lambda s, d, f=getattr(catalog, name), kept={}: kept.setdefault(d, None) or kept.update({d: written(f(s, d))}) or kept[d])
        yield


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(SQL) - LARGE))
def test_rows_equal_the_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert list(df.columns) == columns
    want = sorted((tuple(map(cell, r)) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(map(cell, r)) for r in df.collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1.0, abs(y))), (a, b)
