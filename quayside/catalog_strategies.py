"""Registered queries of two strategies' forecasts with their guards, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside.catalog import _METRICS, _OOF, _STRATUM, MODELS, ORIGINS, _r
from quayside.catalog_decisions import _BOUNDS, _SUM
from quayside.plans import direct, evaluate, models, recursive, strategies
from quayside.sources.shared import written

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    _SQL[name] = sql


#: Models of each strategy; growth is extrapolated from day to day, so that its guards have something to do.
MEMBERS = {"direct": MODELS, "recursive": ["baseline", "moving_avg", "growth", "growth_bounded"]}
BLENDS = {"direct": {"baseline": 0.5, "moving_avg": 0.3, "seasonal_naive": 0.2}, "recursive": {"baseline": 0.6, "moving_avg": 0.4}}
#: Origins from this day on are a benchmark, the others for development; residual bounds are learned up to the other day.
BENCHMARK, LEARNED = "2000-01-01", "2000-12-03"


def _bounds(state) -> tuple[float, float]:
    own = models.residual_bounds(direct.trainable(direct.direct_panel(state, 1), LEARNED), 0.05, 0.95, 0.0).first()
    return own.lower, own.upper


def _rows(s, d):
    """Both strategies' rows, written once; so is the state, which every strategy reads."""
    state = written(base._state(s, d))
    flat = evaluate.long_form(direct.naive_forecasts(state, ORIGINS), MODELS)
    steps = {"baseline": recursive.baseline_of, "moving_avg": recursive.mean_step(), "growth": recursive.growth_step}
    made = {m: recursive.forecast(state, ORIGINS, f) for m, f in steps.items()}
    kept = recursive.forecast(state, ORIGINS, recursive.growth_step, bounds=_bounds(state))
    made["growth_bounded"] = kept.withColumns({"residual_min": F.col("residual"), "residual_max": F.col("residual")})
    rolled = [recursive.with_actuals(t.withColumn("model", F.lit(m)), state) for m, t in made.items()]
    split = F.when(F.col("origin") >= F.lit(BENCHMARK).cast("date"), "benchmark").otherwise("development")
    return written(strategies.strategy_rows({"direct": [flat], "recursive": rolled}, split))


def _common(s, d):
    return strategies.with_common(_rows(s, d), MEMBERS)


# SQL --------------------------------------------------------------------------------------------------------------

_AGO = ", ".join(f"CASE WHEN len(h) >= {7 * k} THEN h[len(h) - {7 * k - 1}] END AS a{k - 1}" for k in (1, 2, 3, 4))
_MEDIAN = "list_aggregate(list_slice(h, greatest(len(h) - 6, 1), len(h)), 'median')"
_BASE = f"coalesce(CASE WHEN ({_SUM[1]}) > 0 THEN ({_SUM[0]}) / ({_SUM[1]}) END, {_MEDIAN}, 0.0)"
_LIMIT = "greatest(10000.0, 50 * greatest(coalesce(top, 0.0), coalesce(base, 0.0), 1.0))"
_STEPS = {
    "baseline": _BASE,
    "moving_avg": "list_avg(list_slice(h, greatest(len(h) - 27, 1), len(h)))",
    "growth": "CASE WHEN len(h) >= 8 THEN h[len(h)] * h[len(h)] / nullif(h[len(h) - 7], 0) END",
}


def _round(model: str, step: str, k: int, clipped: bool) -> str:
    """One day of a model's recursion: step, residual, bounds, limit, and the value that becomes history."""
    guard = "coalesce(residual < lower OR residual > upper, false)" if clipped else "false"
    kept = "CASE WHEN guard THEN exp(ln(1 + base) + greatest(lower, least(upper, residual))) - 1 ELSE step END" if clipped else "step"
    return f"""{model}{k} AS (
  SELECT product_id, origin, top, list_append(h, pred) AS h,
    list_append(made, {{'horizon': {k}, 'pred': pred, 'nonfinite': kept IS NULL, 'catastrophic': wild, 'guard': guard, 'residual': residual, 'safety_limit': safety_limit}}) AS made
  FROM (SELECT *, greatest(CASE WHEN kept IS NULL OR wild THEN base ELSE kept END, 0.0) AS pred
  FROM (SELECT *, coalesce(kept > safety_limit, false) AS wild
  FROM (SELECT *, {kept} AS kept, {_LIMIT} AS safety_limit
  FROM (SELECT *, {guard} AS guard
  FROM (SELECT *, ln(1 + step) - ln(1 + base) AS residual
  FROM (SELECT *, {_BASE} AS base, {step} AS step
  FROM (SELECT *, {_AGO} FROM {model}{k - 1}{", bounds" if clipped else ""}))))))))"""


def _recursion(model: str, step: str, clipped: bool = False) -> str:
    return f"{model}0 AS (SELECT product_id, origin, top, h, [] AS made FROM start_),\n" + ",\n".join(_round(model, step, k, clipped) for k in range(1, 8))


def _unrolled(model: str, clipped: bool = False) -> str:
    raw = "x.residual" if clipped else "CAST(NULL AS DOUBLE)"
    return f"""SELECT 'recursive' AS strategy, r.product_id, r.origin, CAST(x.horizon AS BIGINT) AS horizon, s.date_key AS target_date, s.available, s.quantity AS actual, '{model}' AS model, x.pred,
  x.nonfinite OR x.catastrophic AS fallback_used, x.nonfinite, x.catastrophic, x.guard AS residual_guard, {"x.residual IS NULL" if clipped else "false"} AS residual_nonfinite, {raw} AS residual_min, {raw} AS residual_max, x.safety_limit
  FROM (SELECT product_id, origin, unnest(made) AS x FROM {model}7) r JOIN state s ON s.product_id = r.product_id AND s.date_key = r.origin + x.horizon"""


_NO_GUARDS = "false AS fallback_used, false AS nonfinite, false AS catastrophic, false AS residual_guard, false AS residual_nonfinite, CAST(NULL AS DOUBLE) AS residual_min, CAST(NULL AS DOUBLE) AS residual_max, CAST(NULL AS DOUBLE) AS safety_limit"
_PARTS = "\nUNION ALL ".join([
    f"SELECT 'direct' AS strategy, product_id, origin, horizon, target_date, available, actual, model, pred, {_NO_GUARDS} FROM long",
    *[_unrolled(m) for m in _STEPS], _unrolled("growth_bounded", True),
])
_ROWS = f"""{_OOF},
start_ AS (SELECT product_id, origin, top, h FROM (SELECT product_id, date_key AS origin, list(CAST(qty_available AS DOUBLE)) OVER {base._incl(28)} AS h, max(quantity) OVER ({base._W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM state)
  WHERE origin IN ({", ".join(f"DATE '{o}'" for o in ORIGINS)})),
bounds AS (SELECT q[1] AS lower, q[2] AS upper FROM ({_BOUNDS.format("[0.05, 0.95]", LEARNED)})),
{", ".join(_recursion(m, e) for m, e in _STEPS.items())},
{_recursion("growth_bounded", _STEPS["growth"], True)},
every_ AS (SELECT *, CASE WHEN origin >= DATE '{BENCHMARK}' THEN 'benchmark' ELSE 'development' END AS origin_type FROM ({_PARTS})),
both_ AS (SELECT *, coalesce(available, false) AND actual IS NOT NULL AND
  count(pred) OVER (PARTITION BY strategy, product_id, origin, horizon) = CASE WHEN strategy = 'direct' THEN {len(MODELS)} ELSE {len(MEMBERS["recursive"])} END AS ok FROM every_)"""
_FLAGS, _NUMBERS = ", ".join(strategies.FLAGS), ", ".join(_r(c, c) for c in strategies.NUMBERS)
_SPLIT = "origin_type, strategy"

_TABLE = ["strategy", "model", *strategies.KEYS]
_add("snk2_pnl9_guarded_forecasts", lambda s, d: strategies.forecast_table(_rows(s, d)), f"""{_ROWS}
SELECT {", ".join(_TABLE)}, {_r("pred", "raw")}, CASE WHEN pred IS NOT NULL THEN CAST(round_even(greatest(pred, 0.0), 0) AS BIGINT) END AS quantity, {_FLAGS}, {_NUMBERS} FROM every_""")

_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}_count" for c in strategies.FLAGS)
_RATES = ", ".join(_r(f"count(*) FILTER (WHERE {c}) / count(*)", f"{c}_rate") for c in ("fallback_used", "residual_guard"))


def _diagnostics(by: str) -> str:
    return f"""{_ROWS}, m AS (SELECT {by}, max(actual) AS top FROM every_ GROUP BY {by})
SELECT {by}, model, count(*) AS n_rows, count(pred) AS n_finite, {_r("count(pred) / count(*)", "coverage")}, {_COUNTS}, {_RATES},
  {_r("min(residual_min)", "residual_min")}, {_r("max(residual_max)", "residual_max")}, {_r("min(safety_limit)", "safety_limit")}, {_r("max(pred)", "largest")},
  {_r("max(top)", "observed_max")}, {_r("CASE WHEN max(top) > 0 THEN max(pred) / max(top) END", "ratio")}, {_r("quantile_cont(pred, 0.99)", "p99")}
FROM every_ JOIN m USING ({by}) GROUP BY {by}, model"""


_add("agg16_guards_by_split", lambda s, d: strategies.diagnostics(_rows(s, d)), _diagnostics(_SPLIT))
_add("agg16_guards_by_origin", lambda s, d: strategies.diagnostics(_rows(s, d), (*strategies.SPLIT, "origin")), _diagnostics(f"{_SPLIT}, origin"))
_add("agg17_split_top_demand", lambda s, d: strategies.top_demand(_common(s, d), MEMBERS), f"""{_ROWS},
q AS (SELECT {_SPLIT}, quantile_cont(actual, 0.9) AS threshold FROM both_ WHERE ok AND model = 'baseline' GROUP BY {_SPLIT})
SELECT {_SPLIT}, model, {_r("any_value(threshold)", "threshold")}, {_METRICS} FROM both_ JOIN q USING ({_SPLIT}) WHERE ok AND actual >= threshold GROUP BY {_SPLIT}, model""")


def _errors(s, d):
    rows = strategies.largest_errors(_common(s, d).withColumn("pred", F.round("pred", 6)))
    return rows.select(*strategies.SPLIT, "model", *strategies.KEYS, "stratum", "actual", "pred", "signed_error", "absolute_error", "rank")


_add("srt1_split_largest_errors", _errors, f"""{_ROWS}, e AS (SELECT *, round(pred, 6) AS p FROM both_ WHERE ok),
r AS (SELECT *, {_STRATUM} AS stratum, row_number() OVER (PARTITION BY {_SPLIT}, model ORDER BY abs(p - actual) DESC, product_id, origin, horizon) AS rank FROM e)
SELECT {_SPLIT}, model, {", ".join(strategies.KEYS)}, stratum, {_r("actual", "actual")}, {_r("p", "pred")}, {_r("p - actual", "signed_error")}, {_r("abs(p - actual)", "absolute_error")}, rank FROM r WHERE rank <= 100""")

_COMPACT = ", ".join(["n", *[_r(c, c) for c in ("wape", "mae", "rmse", "bias_ratio")]])
_add("agg18_compact_summary", lambda s, d: strategies.compact(_rows(s, d)), f"""{_ROWS},
v AS (SELECT *, {_STRATUM} AS stratum FROM every_ WHERE coalesce(available, false) AND actual IS NOT NULL AND pred IS NOT NULL),
q AS (SELECT strategy, model, quantile_cont(actual, 0.9) AS cutoff FROM v GROUP BY ALL),
g AS (SELECT strategy, model, CASE WHEN grouping(origin) = 0 THEN 'by_origin' WHEN grouping(horizon) = 0 THEN 'by_horizon' WHEN grouping(stratum) = 0 THEN 'by_stratum' ELSE 'all' END AS scope,
  coalesce(CAST(origin AS VARCHAR), CAST(horizon AS VARCHAR), stratum) AS value, CAST(NULL AS DOUBLE) AS cutoff, {_METRICS}
  FROM v GROUP BY GROUPING SETS ((strategy, model), (strategy, model, origin), (strategy, model, horizon), (strategy, model, stratum))),
t AS (SELECT strategy, model, 'top_decile' AS scope, CAST(NULL AS VARCHAR) AS value, any_value(cutoff) AS cutoff, {_METRICS} FROM v JOIN q USING (strategy, model) WHERE actual >= cutoff GROUP BY strategy, model)
SELECT strategy, model, scope, value, {_r("cutoff", "cutoff")}, {_COMPACT} FROM g UNION ALL SELECT strategy, model, scope, value, {_r("cutoff", "cutoff")}, {_COMPACT} FROM t""")

_SUMS = "CASE " + " ".join(f"WHEN strategy = '{s}' AND model = '{m}' THEN {w}::DOUBLE" for s, own in BLENDS.items() for m, w in own.items()) + " END"
_BLENDED = f"""{_ROWS}, w AS (SELECT *, {_SUMS} AS w FROM every_),
blended AS (SELECT strategy, origin_type, product_id, origin, horizon, target_date, any_value(available) AS available, any_value(actual) AS actual, 'ensemble' AS model,
  CASE WHEN count(pred) = {len(BLENDS["direct"])} OR (strategy = 'recursive' AND count(pred) = {len(BLENDS["recursive"])}) THEN sum(w * pred) END AS pred
  FROM w WHERE w IS NOT NULL GROUP BY strategy, origin_type, product_id, origin, horizon, target_date)"""
_add("ens4_guarded_blend", lambda s, d: strategies.blended(_rows(s, d), BLENDS).select("origin_type", "strategy", "model", *strategies.KEYS, "pred", *strategies.FLAGS, *strategies.NUMBERS),
     f"{_BLENDED} SELECT origin_type, strategy, model, {', '.join(strategies.KEYS)}, {_r('pred', 'pred')}, {_NO_GUARDS} FROM blended")


def _scores(s, d):
    """WAPE of the development origins over rows that all models of a strategy and its blend have."""
    rows = _rows(s, d)
    every = rows.unionByName(strategies.blended(rows, BLENDS))
    common = strategies.with_common(every, {k: [*m, "ensemble"] for k, m in MEMBERS.items()})
    return written(common.where("common and origin_type = 'development'").groupBy("strategy", "model").agg(*evaluate.metrics()).select("strategy", "model", "wape"))


def _canonical(s, d):
    scores = _scores(s, d)
    accepted = strategies.accepted_ensembles(scores)
    asked = {"any": {}, "baseline": {"model": "baseline"}, "recursive": {"strategy": "recursive"}, "ensemble": {"model": "ensemble"}}
    out = None
    for name, how in asked.items():
        one = strategies.canonical(scores, accepted, **how).select(F.lit(name).alias("asked"), "model", "strategy", "wape")
        out = one if out is None else out.unionByName(one)
    return out


_add("sel3_canonical_choice", _canonical, f"""{_BLENDED},
u AS (SELECT strategy, origin_type, product_id, origin, horizon, available, actual, model, pred FROM every_ UNION ALL SELECT strategy, origin_type, product_id, origin, horizon, available, actual, model, pred FROM blended),
k AS (SELECT *, count(pred) OVER (PARTITION BY strategy, product_id, origin, horizon) = CASE WHEN strategy = 'direct' THEN {len(MODELS) + 1} ELSE {len(MEMBERS["recursive"]) + 1} END AS ok FROM u),
s AS (SELECT strategy, model, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape FROM k WHERE ok AND coalesce(available, false) AND actual IS NOT NULL AND origin_type = 'development' GROUP BY strategy, model),
a AS (SELECT strategy FROM s GROUP BY strategy HAVING min(wape) FILTER (WHERE model = 'ensemble') <= 0.998 * min(wape) FILTER (WHERE model <> 'ensemble')),
c AS (SELECT 'any' AS asked, * FROM s WHERE model <> 'ensemble' OR strategy IN (FROM a) UNION ALL SELECT 'baseline', * FROM s WHERE model = 'baseline'
  UNION ALL SELECT 'recursive', * FROM s WHERE strategy = 'recursive' AND (model <> 'ensemble' OR strategy IN (FROM a)) UNION ALL SELECT 'ensemble', * FROM s WHERE model = 'ensemble')
SELECT asked, model, strategy, {_r("wape", "wape")} FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(wape, 9), model, strategy) AS r FROM c) WHERE r = 1""")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
