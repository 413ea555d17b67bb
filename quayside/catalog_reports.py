"""Registered queries of sinks read back, representations, screening tables and further models, with SQL where it gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside.catalog import _LAGGED, _OOF, _STATE, _STRATUM, MODELS, ORIGINS, _r
from quayside.functions import scalar
from quayside.operators import anomaly, blend, representation
from quayside.plans import direct, evaluate, models
from quayside.sources import panel as source
from quayside.sources import sinks
from quayside.sources.shared import shared_dir, written

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    if sql:
        _SQL[name] = sql


def _folder(s) -> str:
    return f"{shared_dir(s)}/report-{uuid.uuid4().hex}"


# sinks, read back -------------------------------------------------------------------------------------------------


def _submitted(s, d):
    path = _folder(s)
    sinks.write_submission(base._oof(s, d).where("pred_baseline is not null"), path, "pred_baseline")
    return s.read.parquet(f"{path}/parquet")


_add("snk1_submission", _submitted, f"{_OOF} SELECT product_id, target_date, CAST(round_even(greatest(pred_baseline, 0), 0) AS BIGINT) AS quantity FROM oof")


def _stored(s, d):
    """Two writes, the second for the origins that the first lacks."""
    path, oof = _folder(s), base._oof(s, d)
    sinks.write_folds(oof.where(F.col("origin") < "1999-01-01"), path)
    left = sinks.missing_folds(oof, s.read.parquet(path))
    sinks.write_folds(oof.join(left, "origin", "left_semi"), path)
    return s.read.parquet(path).groupBy("origin").agg(F.count("*").alias("n"), F.sum("pred_baseline").alias("total"))


_add("snk3_folds", _stored, f"{_OOF} SELECT origin, count(*) AS n, {_r('sum(pred_baseline)', 'total')} FROM oof GROUP BY origin")


def _metric_tables(s, d):
    path = _folder(s)
    long = base._long(s, d)
    sinks.write_tables({"folds": evaluate.fold_table(long).select("model", "origin", "regime", "n", "wape"), "models": long.groupBy("model").agg(F.count("pred").alias("n"))}, path)
    schema = "model string, origin date, regime string, n long, wape double"
    return source.read_artefact(s, f"{path}/folds", schema)


_add("snk4_src3_metric_tables", _metric_tables, f"{_OOF}, rg AS (SELECT *, 'realized' AS regime FROM long UNION ALL SELECT *, 'conditional' FROM long WHERE coalesce(available, false)) SELECT model, origin, regime, count(actual) {base._OK} AS n, {_r(f'CASE WHEN sum(abs(actual)) {base._OK} > 0 THEN sum(abs(pred - actual)) {base._OK} / sum(abs(actual)) {base._OK} END', 'wape')} FROM rg GROUP BY model, origin, regime")
_add("snk6_json_safe", lambda s, d: sinks.json_safe(base._state(s, d).select("product_id", "date_key", (F.col("quantity_app") * 1e308 * 1e10).alias("huge"), "price")), f"{_STATE} SELECT product_id, strftime(date_key, '%Y-%m-%d') AS date_key, CASE WHEN quantity_app = 0 THEN 0.0 END::DOUBLE AS huge, {_r('price', 'price')} FROM state")

# representations --------------------------------------------------------------------------------------------------

_LONG = f"""{_LAGGED}, lv AS (SELECT product_id, date_key, ln(1 + greatest(qty_available, 0.0)) AS lev, qty_available, b4321, is_available FROM based),
rep AS (SELECT date_key, product_id, 'level' AS kind, CASE WHEN qty_available IS NOT NULL THEN lev END AS value FROM lv UNION ALL SELECT date_key, product_id, 'weekday_residual', CASE WHEN qty_available IS NOT NULL AND b4321 IS NOT NULL THEN lev - ln(1 + greatest(b4321, 0.0)) END FROM lv UNION ALL SELECT date_key, product_id, 'available', CAST(is_available AS DOUBLE) FROM lv)"""
_add("anm6_representation", lambda s, d: representation.representation(base._state(s, d)), f"{_LONG} SELECT date_key, product_id, kind, {_r('value', 'value')} FROM rep")


def _prepared(s, d):
    rows = representation.representation(base._state(s, d), "level_residual")
    return representation.prepared(rows, representation.preparation(rows, "1998-12-31"))


_add("mdl18_prepared", _prepared, f"""{_LONG}, k AS (SELECT * FROM rep WHERE kind <> 'available'), md AS (SELECT product_id, kind, coalesce(median(value), 0.0) AS med FROM k WHERE date_key <= DATE '1998-12-31' GROUP BY 1, 2),
st AS (SELECT k.product_id, k.kind, any_value(med) AS med, avg(coalesce(value, med)) AS mean, CASE WHEN stddev_pop(coalesce(value, med)) > 1e-6 THEN stddev_pop(coalesce(value, med)) ELSE 1.0 END AS sc FROM k JOIN md ON k.product_id = md.product_id AND k.kind = md.kind WHERE date_key <= DATE '1998-12-31' GROUP BY 1, 2)
SELECT k.product_id, k.kind, date_key, {_r('greatest(-8.0, least(8.0, (coalesce(value, med) - mean) / sc))', 'value')} FROM k JOIN st ON k.product_id = st.product_id AND k.kind = st.kind""")


def _market_windows(s, d):
    return representation.sliding(anomaly.market_state(base._state(s, d)), ["demand", "n_available"], 28)


def _window_sums(s, d):
    flat = F.transform(F.flatten("window"), lambda x: F.coalesce(x, F.lit(0.0)))
    return _market_windows(s, d).select("date_key", F.size("window").alias("days"), F.get(F.get("window", F.lit(0)), F.lit(1)).alias("first"), F.get(F.get("window", F.lit(27)), F.lit(1)).alias("last"), F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"))


_add("win25_sliding_windows", _window_sums, f"{_STATE}, m AS (SELECT date_key, sum(qty_available) AS demand, sum(is_available) AS n FROM state GROUP BY date_key), w AS (SELECT date_key, list(CAST(n AS DOUBLE)) OVER o AS ns, sum(coalesce(demand, 0) + n) OVER o AS total FROM m WINDOW o AS (ORDER BY date_key ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)) SELECT date_key, len(ns) AS days, ns[1] AS first, ns[28] AS last, {_r('total', 'total')} FROM w WHERE len(ns) = 28")
_add("mdl17_reconstruction", lambda s, d: representation.reconstruction(_market_windows(s, d), "1999-12-31"), None)
_PRICED = representation.feature_columns(("price", "campaign"))
_add("prj22_feature_columns", lambda s, d: direct.direct_panel(base._state(s, d), 1, price=True, origins=ORIGINS).select("product_id", "origin", *_PRICED), f"{base._LAGGED}, {base._PRICED}, {base._PANEL_ROWS}, pp AS (SELECT {base._PANEL_COLUMNS} FROM t o JOIN x ON o.product_id = x.product_id AND o.date_key = x.origin WHERE x.horizon = 1 AND o.date_key IN ({base._DATES})) SELECT product_id, origin, {', '.join(_PRICED)} FROM pp")

# screening --------------------------------------------------------------------------------------------------------

_VARIANTS = ("w4321", "w8421", "lag7", "median")


def _candidates(s, d):
    """Every variant of the baseline as a candidate: scores of its rows, and the test-aligned score."""
    state, out = base._state(s, d), None
    for v in _VARIANTS:
        p = direct.direct_panel(state, 7, origins=ORIGINS, variant=v)
        one = p.select(F.lit(v).alias("candidate"), "product_id", "origin", "horizon", "available", F.col("target").alias("actual"), F.col("target_baseline").alias("pred"))
        out = one if out is None else out.unionByName(one)
    return out


def _screened(s, d):
    rows = _candidates(s, d).where("available and actual is not null")
    own = rows.groupBy("candidate").agg(*evaluate.metrics())
    aligned = evaluate.test_aligned(rows.withColumns({"common": F.lit(True), "model": F.col("candidate")})).select(F.col("model").alias("candidate"), "test_aligned_wape")
    return own.join(aligned, "candidate").select("candidate", "n", "mae", "wape", "bias_ratio", "test_aligned_wape")


_ALL4 = "(CASE WHEN {a} IS NOT NULL OR {b} IS NOT NULL OR {c} IS NOT NULL OR {d} IS NOT NULL THEN list_median(list_filter([{a}, {b}, {c}, {d}], lambda x: x IS NOT NULL)) END)".format(a="t.l7", b="t.l14", c="t.l21", d="t.l28")
_BY_VARIANT = {"w4321": "t.b4321", "w8421": "t.b8421", "lag7": "t.l7", "median": _ALL4.replace("list_median(", "list_aggregate(").replace("lambda x: x IS NOT NULL)) END", "lambda x: x IS NOT NULL), 'median') END")}
_CANDS = f"{_LAGGED}, {base._AHEAD}, cd AS (" + " UNION ALL ".join(f"SELECT '{v}' AS candidate, o.date_key AS origin, t.quantity AS actual, coalesce({e}, o.at_origin) AS pred FROM based o JOIN ahead t ON o.product_id = t.product_id AND o.date_key = t.origin WHERE t.origin IN ({base._DATES}) AND t.available AND t.quantity IS NOT NULL" for v, e in _BY_VARIANT.items()) + ")"
_ALIGNED = f"st AS (SELECT candidate, {_STRATUM} AS stratum, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape FROM cd GROUP BY 1, 2), al AS (SELECT candidate, sum(w * wape) / sum(w) AS ta FROM (SELECT *, CASE stratum WHEN 'winter' THEN 0.6 WHEN 'regular' THEN 0.25 ELSE 0.15 END::DOUBLE AS w FROM st WHERE wape IS NOT NULL) GROUP BY candidate)"
_OWN = "ow AS (SELECT candidate, count(*) AS n, avg(abs(pred - actual)) AS mae, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape, sum(pred - actual) / nullif(sum(abs(actual)), 0) AS bias_ratio FROM cd GROUP BY candidate)"
_add("agg28_candidate_rows", _screened, f"{_CANDS}, {_ALIGNED}, {_OWN} SELECT candidate, n, {_r('mae', 'mae')}, {_r('wape', 'wape')}, {_r('bias_ratio', 'bias_ratio')}, {_r('ta', 'test_aligned_wape')} FROM ow JOIN al USING (candidate)")
_FROZEN = {"baseline": 0.5, "seasonal_naive": 0.2, "moving_avg": 0.3}
_AUDIT = ORIGINS[-3:]


def _audit(s, d):
    """A frozen blend on the audit's origins: nothing is fitted there."""
    oof = base._oof(s, d).where(F.col("origin").isin([F.lit(o).cast("date") for o in _AUDIT])).withColumn("pred_ensemble", blend.apply_weights(base._oof(s, d), _FROZEN))
    long = evaluate.long_form(oof, [*MODELS, "ensemble"]).withColumn("stratum", scalar.stratum(F.col("origin"))).where("common")
    return evaluate.in_display_order(long.groupBy("model", "stratum").agg(*evaluate.metrics())).select("model", "stratum", "place", "n", "mae", "wape", "bias_ratio")


_ENS = "greatest(pred_baseline * 0.5 + pred_seasonal_naive * 0.2 + pred_moving_avg * 0.3, 0.0)"
_add("sel14_frozen_audit", _audit, f"{_OOF}, k AS (SELECT *, {_STRATUM} AS stratum, {_ENS} AS pred_ensemble FROM oof WHERE origin IN ({', '.join(f'DATE {chr(39)}{o}{chr(39)}' for o in _AUDIT)}) AND available AND actual IS NOT NULL AND pred_baseline IS NOT NULL AND pred_seasonal_naive IS NOT NULL AND pred_moving_avg IS NOT NULL), u AS (UNPIVOT k ON pred_baseline, pred_seasonal_naive, pred_moving_avg, pred_ensemble INTO NAME model VALUE pred), g AS (SELECT replace(model, 'pred_', '') AS model, stratum, count(*) AS n, avg(abs(pred - actual)) AS mae, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape, sum(pred - actual) / nullif(sum(abs(actual)), 0) AS bias_ratio FROM u GROUP BY 1, 2) SELECT model, stratum, dense_rank() OVER (ORDER BY CASE model WHEN 'ensemble' THEN 7 WHEN 'baseline' THEN 8 WHEN 'seasonal_naive' THEN 9 ELSE 10 END) AS place, n, {_r('mae', 'mae')}, {_r('wape', 'wape')}, {_r('bias_ratio', 'bias_ratio')} FROM g")


def _violations(s, d):
    """Stated evidence on candidates, checked against what its own rows give."""
    rows = _screened(s, d).select("candidate", "wape")
    control = rows.where("candidate = 'w4321'").select(F.col("wape").alias("control"))
    stated = rows.crossJoin(F.broadcast(control)).withColumn("stated", F.round(1 - F.col("wape") / F.col("control"), 3))  # one row
    best = F.min("wape").alias("best")
    own = stated.crossJoin(F.broadcast(rows.agg(best)))  # one row
    derived = 1 - F.col("wape") / F.col("control")
    return own.select("candidate", (F.abs(F.col("stated") - derived) > 5e-4).alias("improvement_differs"), F.col("wape").isNull().alias("missing"), ((F.col("wape") == F.col("best")) & (F.col("candidate") != "w4321")).alias("beats_control"))


_add("sel13_evidence_check", _violations, f"{_CANDS}, {_OWN}, c AS (SELECT wape AS control FROM ow WHERE candidate = 'w4321'), b AS (SELECT min(wape) AS best FROM ow) SELECT candidate, abs(round(1 - wape / control, 3) - (1 - wape / control)) > 5e-4 AS improvement_differs, wape IS NULL AS missing, wape = best AND candidate <> 'w4321' AS beats_control FROM ow, c, b")

# models: SQL cannot express the fits ------------------------------------------------------------------------------


def _walked(kind: str, origins=ORIGINS[-3:]):
    """A fit per origin on the rows up to it, and the errors of its week ahead."""

    def query(s, d):
        oof = models.walk_forward(written(direct.direct_panel(base._state(s, d))), origins, kind)
        return oof.where(F.coalesce("available", F.lit(False))).groupBy("origin").agg(*evaluate.metrics())

    return query


_add("pnl5_mdl1_ridge_by_origin", _walked("ridge"), None)
_add("mdl5_factor_machine", _walked("factor", ORIGINS[-1:]), None)


def _final_ridge(s, d):
    history, ahead = base._split(s, d)
    return models.final_forecast(history, ahead, "ridge").select("product_id", "target_date", "horizon", "pred")


_add("pnl13_final_ridge", _final_ridge, None)


def _shares(s, d):
    panel = written(direct.direct_panel(base._state(s, d), 7))
    return models.fit_share(direct.trainable(panel, "2000-12-03"), panel.where(F.col("origin").isin([F.lit(o).cast("date") for o in ORIGINS[-2:]]))).groupBy("horizon").agg(F.avg("share").alias("share"), F.count("*").alias("n"))


_add("mdl7_app_share", _shares, None)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
