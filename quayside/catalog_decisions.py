"""Registered queries of recursive forecasts, context, choices and sinks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside.catalog import _LAGGED, _OOF, _SCORED, _STATE, _STRATUM, MODELS, ORIGINS, _incl, _r
from quayside.functions import scalar
from quayside.operators import anomaly, blend, context, select, windows
from quayside.plans import direct, models, recursive
from quayside.sources import sinks

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    if sql:
        _SQL[name] = sql


# recursive forecasts ----------------------------------------------------------------------------------------------

_STEP = "list_append(h, coalesce(list_avg(list_slice(h, greatest(len(h) - 27, 1), len(h))), 0.0))"
#: The value d days before the target of horizon k; null before the history's start.
_AGO = "CASE WHEN n + k - {0} >= 1 THEN h[n + k - {0}] END"
_SAME = ", ".join(f"{_AGO.format(7 * (i + 1))} AS a{i}" for i in range(4))
_SUM = " + ".join(f"coalesce(a{i} * {4 - i}, 0.0)" for i in range(4)), " + ".join(f"CASE WHEN a{i} IS NOT NULL THEN {4 - i}.0 ELSE 0.0 END" for i in range(4))
_REC = (
    _OOF
    + f""",
h0 AS (SELECT product_id, date_key AS origin, list(CAST(qty_available AS DOUBLE)) OVER {_incl(28)} AS h, max(quantity) OVER ({base._W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM state),
g0 AS (SELECT *, len(h) AS n FROM h0 WHERE origin IN ({", ".join(f"DATE '{o}'" for o in ORIGINS)})),
"""
    + ",\n".join(f"g{k} AS (SELECT product_id, origin, {_STEP} AS h, n, top FROM g{k - 1})" for k in range(1, 8))
    + f""",
rec0 AS (SELECT product_id, origin, CAST(k AS BIGINT) AS horizon, CAST(origin + CAST(k AS INT) AS DATE) AS target_date, h[n + k] AS pred, top, {_SAME},
  list_aggregate(list_slice(h, greatest(n + k - 7, 1), n + k - 1), 'median') AS med, list_avg(list_slice(h, greatest(n + k - 28, 1), n + k - 1)) IS NULL AS nonfinite FROM g7, range(1, 8) r(k)),
rec AS (SELECT product_id, origin, horizon, target_date, pred, nonfinite, nonfinite AS fallback_used, false AS catastrophic,
  greatest(10000.0, 50 * greatest(coalesce(top, 0.0), coalesce(CASE WHEN ({_SUM[1]}) > 0 THEN ({_SUM[0]}) / ({_SUM[1]}) END, med, 0.0), 1.0)) AS safety_limit FROM rec0),
paired AS (SELECT rec.*, s.quantity AS actual, s.available FROM rec JOIN state s ON s.product_id = rec.product_id AND s.date_key = rec.target_date)"""
)


def _recursive(s, d):
    return recursive.forecast(base._state(s, d), ORIGINS)


def _paired(s, d):
    return recursive.with_actuals(_recursive(s, d), base._state(s, d))


_add("pnl6_recursive_forecast", _recursive, f"{_REC} SELECT product_id, origin, horizon, target_date, {_r('pred', 'pred')}, fallback_used, nonfinite, catastrophic, {_r('safety_limit', 'safety_limit')} FROM rec")
_SCORED_ROWS = "FILTER (WHERE available AND actual IS NOT NULL)"
_add("pnl16_jn7_recursion_stability", lambda s, d: recursive.stability(_paired(s, d)), f"{_REC}, a AS (SELECT origin, sum(abs(pred - actual)) {_SCORED_ROWS} / nullif(sum(abs(actual)) {_SCORED_ROWS}, 0) AS wape, max(pred) AS largest, max(pred) / greatest(max(actual), 1.0) AS ratio, count(*) FILTER (WHERE fallback_used) AS fallbacks, count(*) FILTER (WHERE catastrophic) AS beyond_limit, count(*) FILTER (WHERE paired.nonfinite) AS nonfinite FROM paired GROUP BY origin) SELECT origin, {_r('wape', 'wape')}, {_r('largest', 'largest')}, {_r('ratio', 'ratio')}, fallbacks, beyond_limit, a.nonfinite, coalesce(largest <= 5000 AND ratio <= 20 AND wape < 2, false) AS passes FROM a")


def _both_strategies(s, d):
    flat = base._long(s, d).where("model = 'moving_avg'")
    return recursive.compare(flat, _recursive(s, d).withColumn("model", F.lit("moving_avg")))


_PAIR = {"mae": "avg(abs({0} - actual))", "rmse": "sqrt(avg(({0} - actual) * ({0} - actual)))", "wape": "sum(abs({0} - actual)) / nullif(sum(abs(actual)), 0)", "smape": "avg(2 * abs({0} - actual) / (abs(actual) + abs({0}) + 1e-8))", "bias": "avg({0} - actual)"}
_add("agg14_jn8_strategy_pair", _both_strategies, f"""{_REC}, b AS (SELECT o.actual, o.pred_moving_avg AS d, r.pred AS r FROM oof o JOIN rec r USING (product_id, origin, horizon) WHERE o.available AND o.actual IS NOT NULL AND o.pred_moving_avg IS NOT NULL AND r.pred IS NOT NULL),
m AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric, {v.format('d')} AS direct, {v.format('r')} AS recursive FROM b" for k, v in _PAIR.items())})
SELECT 'moving_avg' AS model, metric, {_r('direct', 'direct')}, {_r('recursive', 'recursive')}, {_r('recursive - direct', 'delta')}, CASE WHEN abs(direct) <= abs(recursive) THEN 'direct' ELSE 'recursive' END AS winner FROM m""")
_ONE_STEP = f"{_LAGGED}, t AS (SELECT *, lag(date_key) OVER ({base._W}) AS origin, coalesce(b4321, lag(at_origin) OVER ({base._W})) AS target_baseline, lag(qty_available) OVER ({base._W}) AS lag_0 FROM based)"
_add("pnl3_one_step_panel", lambda s, d: direct.direct_panel(base._state(s, d), 1).select("product_id", "origin", "horizon", "target_date", "target", "target_baseline", "lag_0", "season_7"), f"{_ONE_STEP} SELECT product_id, origin, CAST(1 AS BIGINT) AS horizon, date_key AS target_date, {_r('quantity', 'target')}, {_r('target_baseline', 'target_baseline')}, {_r('lag_0', 'lag_0')}, {_r('l7', 'season_7')} FROM t WHERE origin IS NOT NULL")


def _bounds(s, d):
    p = direct.trainable(direct.direct_panel(base._state(s, d), 1), "2000-12-03")
    return models.residual_bounds(p)


#: The log residuals' quantiles q of one-step rows up to a day.
_BOUNDS = "SELECT quantile_cont(ln(1 + quantity) - ln(1 + target_baseline), {}) AS q FROM (" + _ONE_STEP.removeprefix(_LAGGED + ", t AS (").removesuffix(")") + ") WHERE origin IS NOT NULL AND available AND quantity IS NOT NULL AND target_baseline IS NOT NULL AND date_key <= DATE '{}'"
_add("pnl9_residual_bounds", _bounds, f"{_LAGGED}, q AS ({_BOUNDS.format('[0.001, 0.999]', '2000-12-03')}) SELECT {_r('q[1] - 1', 'lower')}, {_r('q[2] + 1', 'upper')} FROM q")


def _step_by_step(s, d):
    """The same model twice: as rounds of one-step panels, on covariates known ahead, for the week after the cut."""
    history, ahead = base._split(s, d)
    return recursive.forecast_with(history, ahead, lambda panel: panel.withColumn("pred", F.col("target_baseline"))).select("product_id", "origin", "horizon", "target_date", "pred", "fallback_used", "safety_limit")


_WEEK = f"""{base._FUTURE}, top_ AS (SELECT product_id, max(quantity) AS top FROM state WHERE NOT is_future GROUP BY product_id),
hist AS (SELECT s.product_id, list(CAST(s.qty_available AS DOUBLE) ORDER BY s.date_key) AS h FROM state s JOIN last_ l ON s.product_id = l.product_id AND s.date_key <= l.last AND s.date_key > l.last - 28 GROUP BY s.product_id),
w0 AS (SELECT hist.product_id, last, top, h, len(h) AS n FROM hist JOIN last_ USING (product_id) JOIN top_ USING (product_id) WHERE last = (SELECT cut FROM cutoff))"""


def _next(k: int) -> str:
    ago = ", ".join(f"CASE WHEN len(h) - {7 * (i + 1) - 1} >= 1 THEN h[len(h) - {7 * (i + 1) - 1}] END AS a{i}" for i in range(4))
    made = f"coalesce(CASE WHEN ({_SUM[1]}) > 0 THEN ({_SUM[0]}) / ({_SUM[1]}) END, list_aggregate(list_slice(h, greatest(len(h) - 6, 1), len(h)), 'median'), 0.0)"
    return f"w{k} AS (SELECT product_id, last, top, n, list_append(h, {made}) AS h FROM (SELECT *, {ago} FROM w{k - 1}))"


_WEEK += ", " + ", ".join(_next(k) for k in range(1, 8))
_add("pnl7_14_recursive_rounds", _step_by_step, f"{_WEEK} SELECT product_id, last AS origin, CAST(k AS BIGINT) AS horizon, CAST(last + CAST(k AS INT) AS DATE) AS target_date, {_r('h[n + k]', 'pred')}, false AS fallback_used, {_r('greatest(10000.0, 50 * greatest(coalesce(top, 0.0), h[n + k], 1.0))', 'safety_limit')} FROM w7, range(1, 8) r(k) WHERE EXISTS (SELECT 1 FROM filled f, cutoff WHERE f.product_id = w7.product_id AND f.date_key = cut + CAST(k AS INT))")

# context ----------------------------------------------------------------------------------------------------------

_add("agg25_category_shares", lambda s, d: context.category_shares(base._filled(s, d), ["campaign_web", "campaign_app", "is_promo"]), f"{_STATE}, v AS (SELECT 'campaign_web' AS feature, CAST(campaign_web AS VARCHAR) AS value FROM filled UNION ALL SELECT 'campaign_app', CAST(campaign_app AS VARCHAR) FROM filled UNION ALL SELECT 'is_promo', CAST(is_promo AS VARCHAR) FROM filled), c AS (SELECT feature, coalesce(value, 'missing') AS value, count(*) AS n FROM v GROUP BY 1, 2) SELECT feature, value, n, {_r('n / sum(n) OVER (PARTITION BY feature)', 'share')} FROM c")
_NUMERIC = ["price", "discount_web", "discount_app", "quantity"]
_add("agg26_robust_scale", lambda s, d: context.robust_scale(base._filled(s, d), _NUMERIC), f"{_STATE}, v AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM filled''' for c in _NUMERIC)}), g AS (SELECT feature, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, stddev_pop(value) AS sd FROM v GROUP BY feature) SELECT feature, {_r('q[2]', 'median')}, {_r('CASE WHEN q[3] > q[1] THEN (q[3] - q[1]) / 1.349 WHEN sd > 0 THEN sd ELSE 1.0 END', 'scale')} FROM g")
_add("agg27_weekly_lift", lambda s, d: context.weekly_lift(base._state(s, d)), f"{_STATE}, l AS (SELECT product_id, max(date_key) AS last, arg_max(qty_available, date_key) FILTER (WHERE qty_available IS NOT NULL) AS latest FROM state GROUP BY product_id), g AS (SELECT product_id, avg(qty_available) FILTER (WHERE last - date_key BETWEEN 0 AND 6) AS recent_mean, avg(qty_available) FILTER (WHERE last - date_key BETWEEN 7 AND 13) AS before, avg(CAST(qty_available <= latest AS INT)) AS percentile FROM state JOIN l USING (product_id) GROUP BY product_id) SELECT product_id, {_r('recent_mean', 'recent_mean')}, {_r('before', 'before')}, {_r('percentile', 'percentile')}, {_r('recent_mean / nullif(before, 0) - 1', 'lift')} FROM g")
_add("win24_empirical_rank", lambda s, d: anomaly.scores(base._state(s, d)).withColumn("key", F.round("score", 9)).select("product_id", "date_key", context.empirical_rank("product_id", "key").alias("rank")), f"{_SCORED}, k AS (SELECT product_id, date_key, round(score, 9) AS key FROM scored) SELECT product_id, date_key, {_r('CASE WHEN key IS NOT NULL THEN cume_dist() OVER (PARTITION BY product_id, key IS NULL ORDER BY key) END', 'rank')} FROM k")
_add("srt2_agg30_top_days", lambda s, d: context.top_days(anomaly.scores(base._state(s, d)).withColumn("score", F.round("score", 6))).select("product_id", "rank", "date_key", "score", "known_event"), f"{_SCORED}, k AS (SELECT product_id, date_key, round(score, 6) AS score, known_event FROM scored WHERE score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, date_key) AS rank FROM k) SELECT product_id, rank, date_key, {_r('score', 'score')}, known_event FROM r WHERE rank <= 20")
_ENDS = ("1996-12-31", "1998-06-30", "1999-12-31")
_add("anm7_split_counts", lambda s, d: base._state(s, d).groupBy(context.split_of(F.col("date_key"), *_ENDS).alias("split")).agg(F.count("*").alias("n"), F.min("date_key").alias("first"), F.max("date_key").alias("last")), f"{_STATE} SELECT CASE WHEN date_key <= DATE '{_ENDS[0]}' THEN 'train' WHEN date_key <= DATE '{_ENDS[1]}' THEN 'validation' WHEN date_key <= DATE '{_ENDS[2]}' THEN 'calibration' ELSE 'holdout' END AS split, count(*) AS n, min(date_key) AS first, max(date_key) AS last FROM state GROUP BY 1")


def _share_errors(s, d):
    share = windows.channel_history()
    rows = base._state(s, d).select("product_id", "date_key", "qty_available", share["share_lag_0"].alias("actual"), share["share_28"].alias("recent"))
    return context.channel_share_errors(rows.withColumn("pred", F.lag("recent").over(windows.days())), "actual", "pred", "qty_available")


_SHARES = f"""{_STATE}, c AS (SELECT *, CASE WHEN is_available = 1 THEN quantity_app END AS app FROM state),
s AS (SELECT *, CASE WHEN qty_available > 0 THEN app / qty_available END AS actual, CASE WHEN sum(qty_available) OVER {_incl(28)} > 0 THEN sum(app) OVER {_incl(28)} / sum(qty_available) OVER {_incl(28)} END AS recent FROM c),
p AS (SELECT *, lag(recent) OVER (PARTITION BY product_id ORDER BY date_key) AS pred FROM s), k AS (SELECT * FROM p WHERE actual IS NOT NULL AND pred IS NOT NULL)"""
_add("agg15_channel_share_errors", _share_errors, f"{_SHARES} SELECT count(*) AS n, {_r('avg(abs(pred - actual))', 'mae')}, {_r('sum(qty_available * abs(pred - actual)) / nullif(sum(qty_available), 0)', 'weighted_mae')}, {_r('avg(pred - actual)', 'bias')}, {_r('avg(actual)', 'mean_actual')}, {_r('avg(pred)', 'mean_pred')}, {_r('count(*) / (SELECT count(actual) FROM p)', 'coverage')} FROM k")
_add("agg16_prediction_diagnostics", lambda s, d: context.prediction_diagnostics(base._long(s, d)), f"{_OOF} SELECT model, count(*) AS n_rows, count(pred) AS n_known, {_r('max(pred)', 'largest')}, {_r('quantile_cont(pred, 0.99)', 'p99')}, {_r('max(pred) / nullif(max(actual), 0)', 'ratio')} FROM long GROUP BY model")


def _roles(s, d):
    days = base._panel(s, d).select("date_key").distinct()
    role = F.when(F.dayofmonth("date_key") == 1, "development").when(F.dayofmonth("date_key") == 5, "calibration").when(F.dayofmonth("date_key") == 20, "benchmark")
    return days.select(role.alias("role"), F.col("date_key").alias("origin")).where("role is not null")


_add("set4_role_overlaps", lambda s, d: context.role_overlaps(_roles(s, d)), f"{_STATE}, r AS (SELECT DISTINCT CASE day(date_key) WHEN 1 THEN 'development' WHEN 5 THEN 'calibration' ELSE 'benchmark' END AS role, date_key AS origin FROM panel WHERE day(date_key) IN (1, 5, 20)), t AS (SELECT DISTINCT role, CAST(origin + CAST(k AS INT) AS DATE) AS target_date FROM r, range(1, 8) x(k)) SELECT a.target_date, a.role AS role_a, b.role AS role_b FROM t a JOIN t b ON a.target_date = b.target_date AND a.role < b.role")

# choices ----------------------------------------------------------------------------------------------------------

_BLOCKS = f"{_OOF}, tot AS (SELECT origin, sum(abs(actual)) AS volume, sum(abs(pred_baseline - actual)) AS ref, sum(abs(pred_moving_avg - actual)) AS cand FROM oof WHERE available AND actual IS NOT NULL AND pred_baseline IS NOT NULL AND pred_moving_avg IS NOT NULL GROUP BY origin)"
_add("ens14_bootstrap", lambda s, d: select.bootstrap(select.block_totals(base._oof(s, d), "pred_baseline", "pred_moving_avg")), f"{_BLOCKS}, num AS (SELECT *, row_number() OVER (ORDER BY origin) - 1 AS pos FROM tot), n AS (SELECT count(*) AS n FROM num), picks AS (SELECT draw, CAST(concat('0x', substr(md5(concat(draw, '-', place)), 1, 8)) AS BIGINT) % n AS pos FROM n, range(1, 501) a(draw), range(1, 1000) b(place) WHERE place <= n), e AS (SELECT draw, 1 - sum(cand) / nullif(sum(ref), 0) AS gain FROM picks JOIN num USING (pos) GROUP BY draw) SELECT {_r('avg(gain)', 'mean')}, {_r('quantile_cont(gain, 0.025)', 'low')}, {_r('quantile_cont(gain, 0.975)', 'high')}, {_r('avg(CAST(gain > 0 AS INT))', 'p_positive')} FROM e")
_add("sel7_ranking", lambda s, d: select.ranking(base._long(s, d), "baseline"), f"{_OOF}, e AS (SELECT model, origin, sum(abs(pred - actual)) AS e FROM long WHERE common GROUP BY 1, 2), j AS (SELECT e.*, b.e AS r, 1 - e.e / nullif(b.e, 0) AS gain FROM e JOIN e b ON b.origin = e.origin AND b.model = 'baseline'), g AS (SELECT model, 1 - sum(e) / sum(r) AS improvement, avg(CAST(gain > 0 AS INT)) AS won, stddev_pop(gain) AS spread FROM j GROUP BY model) SELECT model, {_r('improvement', 'improvement')}, {_r('won', 'won')}, {_r('spread', 'spread')}, {_r('improvement + 0.05 * won - 0.12 * spread', 'score')} FROM g")
_add("sel4_5_screened_blend", lambda s, d: select.screened(blend.fit(base._oof(s, d), MODELS), F.col("candidate") == "10-0-0").select("candidate", "aligned", "broad", "control_aligned"), f"{base._FIT}, ctl AS (SELECT aligned AS ca, broad AS cb FROM f WHERE candidate = '10-0-0'), fine AS (SELECT f.candidate, f.aligned, f.broad, ca, f.aligned <= 0.998 * ca AS better FROM f, ctl WHERE f.broad <= 1.03 * cb) SELECT candidate, {_r('fine.aligned', 'aligned')}, {_r('fine.broad', 'broad')}, {_r('ca', 'control_aligned')} FROM fine WHERE better OR candidate = '10-0-0' ORDER BY CASE WHEN better THEN 0 ELSE 1 END, round(fine.aligned, 12), candidate LIMIT 1")


def _by_stratum(s, d):
    oof = base._oof(s, d).where("available and actual is not null").withColumn("stratum", scalar.stratum(F.col("origin")))
    return oof.groupBy("stratum").agg(F.count("*").alias("n"), *[(F.sum(F.abs(F.col(f"pred_{m}") - F.col("actual"))) / F.sum("actual")).alias(f"wape_{m}") for m in MODELS])


def _plan(s, d):
    """The best single member of each stratum, as weights, drawn towards the even blend."""
    best = F.least(*[F.round(f"wape_{m}", 9) for m in MODELS])
    won = F.coalesce(*[F.when(F.round(f"wape_{m}", 9) == best, F.lit(m)) for m in MODELS])
    local = _by_stratum(s, d).withColumn("won", won).select("stratum", "n", *[F.when(F.col("won") == m, 1.0).otherwise(0.0).alias(f"w_{m}") for m in MODELS])
    even = base._oof(s, d).agg(*[F.lit(1 / len(MODELS)).alias(f"w_{m}") for m in MODELS])
    return select.shrunk_plan(local, even, MODELS)


_LEAST = "least(" + ", ".join(f"round(wape_{m}, 9)" for m in MODELS) + ")"
_WON = "CASE " + " ".join(f"WHEN round(wape_{m}, 9) = {_LEAST} THEN '{m}'" for m in MODELS) + " END"
_add("ens9_shrunk_stratum_plan", _plan, f"{_OOF}, k AS (SELECT *, {_STRATUM} AS stratum FROM oof WHERE available AND actual IS NOT NULL), g AS (SELECT stratum, count(*) AS n, {', '.join(f'sum(abs(pred_{m} - actual)) / sum(actual) AS wape_{m}' for m in MODELS)} FROM k GROUP BY stratum), w AS (SELECT stratum, n, n / (n + 500.0) AS k, {_WON} AS won FROM g) SELECT stratum, n, " + ", ".join(_r(f"k * CASE WHEN won = '{m}' THEN 1.0 ELSE 0.0 END + (1 - k) / 3.0", f"w_{m}") for m in MODELS) + " FROM w")

# sinks ------------------------------------------------------------------------------------------------------------

_MARK = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
_add("snk7_fingerprint", lambda s, d: sinks.fingerprint(s.read.parquet(f"{d}/lineitem.parquet"), _MARK), "SELECT count(*) AS n_rows, CAST(sum(" + " + ".join(f"CAST({c} IS NULL AS INT)" for c in _MARK) + ") AS BIGINT) AS n_nulls, CAST(coalesce(sum(CAST(concat('0x', substr(md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _MARK) + ")), 1, 8)) AS BIGINT)), 0) AS VARCHAR) AS digest FROM lineitem")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
