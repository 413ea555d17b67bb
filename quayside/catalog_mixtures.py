"""Registered queries of the anomaly layer, tail thresholds, weight plans and their gates, with SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside import catalog_decisions as decisions
from quayside.catalog import _OOF, _SCORED, _STATE, _STRATUM, _W, MODELS, ORIGINS, _r
from quayside.functions import scalar
from quayside.operators import anomaly, blend, mixtures, select, tails
from quayside.plans import direct, evaluate, models
from quayside.sources.shared import written

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    if sql:
        _SQL[name] = sql


# anomaly layer ----------------------------------------------------------------------------------------------------

_ORIGIN = [f"origin_{c}" for c in anomaly.ORIGIN_COLUMNS]


def _origin_state(s, d):
    state = base._state(s, d)
    return anomaly.attach_origin_state(state, anomaly.profile(state)).select("product_id", "date_key", *_ORIGIN)


_add("jn4_6_origin_state", _origin_state, f"{_SCORED} SELECT product_id, date_key, {', '.join(_r(f'CAST({c} AS DOUBLE)', f'origin_{c}') for c in anomaly.ORIGIN_COLUMNS)} FROM profile")


def _layered(s, d):
    state = base._state(s, d)
    panel = lambda rows, keep: direct.trainable(direct.direct_panel(rows, 1, keep=keep), "2000-12-03")
    out = anomaly.anomaly_layer(state, panel, anomaly.profile(state, policy="signed"), mode="both")
    return out.select("product_id", "origin", "target_date", "sample_weight", "target_score", "target_flag", "origin_score", "origin_flag_rate_28")


_SIGNED = base._weight_sql("CASE WHEN residual < 0 THEN down WHEN residual > 0 THEN up ELSE 1.0 END")
_add("jn5_anm5_layered_panel", _layered, f"""{_SCORED}, p AS (SELECT product_id, lag(date_key) OVER ({_W}) AS origin, date_key AS target_date, {_SIGNED} AS w, score AS target_score, flag AS target_flag, lag(score) OVER ({_W}) AS origin_score, lag(flag_rate_28) OVER ({_W}) AS fr, available, quantity, coalesce(b4321, lag(at_origin) OVER ({_W})) AS tb FROM profile),
k AS (SELECT * FROM p WHERE origin IS NOT NULL AND available AND quantity IS NOT NULL AND tb IS NOT NULL AND target_date <= DATE '2000-12-03')
SELECT product_id, origin, target_date, {_r('w / avg(w) OVER ()', 'sample_weight')}, {_r('target_score', 'target_score')}, target_flag, {_r('origin_score', 'origin_score')}, {_r('fr', 'origin_flag_rate_28')} FROM k""")
_add("anm2_tail_threshold", lambda s, d: tails.tail_threshold(anomaly.scores(base._state(s, d))), None)
_add("anm1_tail_profile", lambda s, d: anomaly.profile(base._state(s, d), threshold="tail").groupBy("product_id").agg(F.count_if("flag").alias("flags"), F.avg("weight").alias("weight"), F.first("threshold").alias("threshold")), None)


def _gpd(s, d):
    """Every product's 99.5 % value from its own scores above their 0.9 quantile, by moments."""
    scored = anomaly.scores(base._state(s, d)).where("score is not null").select("product_id", "score")
    cut = scored.groupBy("product_id").agg(F.percentile("score", F.lit(0.9)).alias("u"))
    above = F.col("score") > F.col("u")
    own = scored.join(cut, "product_id").groupBy("product_id", "u").agg(F.avg(above.cast("double")).alias("pu"), F.avg(F.when(above, F.col("score") - F.col("u"))).alias("mean"), F.var_pop(F.when(above, F.col("score") - F.col("u"))).alias("var"))
    xi = 0.5 * (1 - F.col("mean") * F.col("mean") / F.col("var"))
    own = own.where("var > 0").withColumns({"xi": xi, "beta": F.col("mean") * (1 - xi)})
    return own.select("product_id", "u", "xi", "beta", tails.gpd_quantile(F.lit(0.005), F.col("u"), F.col("xi"), F.col("beta"), F.col("pu")).alias("threshold"))


_add("anm3_gpd_quantile", _gpd, f"""{_SCORED}, k AS (SELECT product_id, score FROM scored WHERE score IS NOT NULL), u AS (SELECT product_id, quantile_cont(score, 0.9) AS u FROM k GROUP BY product_id),
m AS (SELECT product_id, u, avg(CAST(score > u AS INT)) AS pu, avg(score - u) FILTER (WHERE score > u) AS mean, var_pop(score - u) FILTER (WHERE score > u) AS var FROM k JOIN u USING (product_id) GROUP BY product_id, u),
x AS (SELECT *, 0.5 * (1 - mean * mean / var) AS xi, mean * (1 - 0.5 * (1 - mean * mean / var)) AS beta FROM m WHERE var > 0)
SELECT product_id, {_r('u', 'u')}, {_r('xi', 'xi')}, {_r('beta', 'beta')}, {_r('CASE WHEN 0.005 >= pu THEN u WHEN abs(xi) < 1e-7 THEN u - beta * ln(0.005 / pu) ELSE u + beta / xi * (pow(0.005 / pu, -xi) - 1) END', 'threshold')} FROM x""")


def _weighted_baseline(s, d):
    state = base._state(s, d)
    prof = anomaly.profile(state).select("product_id", "date_key", "weight")
    rows = state.join(prof, ["product_id", "date_key"])
    return rows.select("product_id", "date_key", mixtures.weighted_lags(rows).alias("baseline"))


_PAST = [(k, f"lag(qty_available, {7 * k}) OVER ({_W})", f"coalesce(lag(weight, {7 * k}) OVER ({_W}), 1.0)") for k in (1, 2, 3, 4)]
_WB = ", ".join(f"{q} AS q{k}, {w} AS v{k}" for k, q, w in _PAST)
_WNUM, _WDEN = " + ".join(f"coalesce(q{k} * v{k} * {5 - k}, 0.0)" for k in (1, 2, 3, 4)), " + ".join(f"CASE WHEN q{k} IS NOT NULL THEN v{k} * {5 - k} ELSE 0.0 END" for k in (1, 2, 3, 4))
_add("pnl17_weighted_baseline", _weighted_baseline, f"{_SCORED}, g AS (SELECT product_id, date_key, {_WB} FROM profile) SELECT product_id, date_key, {_r(f'CASE WHEN ({_WDEN}) > 0 THEN ({_WNUM}) / ({_WDEN}) END', 'baseline')} FROM g")


def _residual_panel(s, d):
    state = base._state(s, d)
    out = mixtures.residual_panel(state, anomaly.profile(state)).where(F.col("origin").isin([F.lit(o).cast("date") for o in ORIGINS]))
    return out.select("product_id", "origin", "horizon", "target_date", "target", "weighted_baseline", "lag_0", "mean_7", "mean_28", "origin_score", "origin_days_since_flag")


_add("pnl18_jn11_residual_panel", _residual_panel, f"""{_SCORED}, g AS (SELECT *, row_number() OVER ({_W}) AS day_, {_WB}, avg(qty_available) OVER {base._incl(7)} AS m7, avg(qty_available) OVER {base._incl(28)} AS m28 FROM profile),
t AS (SELECT product_id, date_key AS target_date, quantity AS target, CASE WHEN ({_WDEN}) > 0 THEN ({_WNUM}) / ({_WDEN}) END AS wb, CAST(h AS BIGINT) AS horizon, CAST(date_key - CAST(h AS INT) AS DATE) AS origin FROM g, range(1, 8) r(h) WHERE day_ > 35)
SELECT t.product_id, t.origin, t.horizon, t.target_date, {_r('t.target', 'target')}, {_r('t.wb', 'weighted_baseline')}, {_r('o.qty_available', 'lag_0')}, {_r('o.m7', 'mean_7')}, {_r('o.m28', 'mean_28')}, {_r('o.score', 'origin_score')}, CAST(o.days_since_flag AS BIGINT) AS origin_days_since_flag
FROM t LEFT JOIN g o ON o.product_id = t.product_id AND o.date_key = t.origin WHERE t.origin IN ({base._DATES})""")

# plans ------------------------------------------------------------------------------------------------------------

#: A scope's sums and objective over the grid's candidates, for the SQL of searches.
_GRID10 = base._GRID
_SUMS = f"""{_OOF}, {_GRID10}, k AS (SELECT * FROM oof WHERE available AND actual IS NOT NULL AND pred_baseline IS NOT NULL AND pred_seasonal_naive IS NOT NULL AND pred_moving_avg IS NOT NULL),
bl AS (SELECT k.*, candidate, greatest(pred_baseline * w_baseline + pred_seasonal_naive * w_seasonal_naive + pred_moving_avg * w_moving_avg, 0.0) AS p FROM k, grid)"""


def _search_sql(name: str, scope: str, stability: float, bias: float) -> str:
    s = f"{scope}, " if scope else ""
    by = f"PARTITION BY {scope} " if scope else ""
    return f"""{name}0 AS (SELECT {s}candidate, origin, sum(abs(p - actual)) AS e, sum(p - actual) AS b, sum(abs(actual)) AS v, sum(abs(pred_baseline - actual)) AS r, count(*) AS c FROM bl GROUP BY {s}candidate, origin),
{name}1 AS (SELECT *, CASE WHEN v > 0 THEN CASE WHEN r > 0 THEN (r - e) / r ELSE 0.0 END END AS gain FROM {name}0),
{name}2 AS (SELECT {s}candidate, sum(c) AS n, sum(e) / sum(v) AS wape, sum(b) / sum(v) AS bias_ratio, 1 - sum(e) / nullif(sum(r), 0) AS improvement, coalesce(stddev_pop(gain), 1.0) AS spread, coalesce(avg(CAST(gain > 0 AS INT)), 0.0) AS won FROM {name}1 GROUP BY {s}candidate HAVING sum(v) > 0),
{name}3 AS (SELECT *, wape + {stability} * spread + {bias} * abs(bias_ratio) AS objective FROM {name}2),
{name} AS (SELECT x.*, w_baseline, w_seasonal_naive, w_moving_avg FROM (SELECT *, row_number() OVER ({by}ORDER BY round(objective, 12), candidate) AS place FROM {name}3) x JOIN grid USING (candidate) WHERE place = 1)"""


def _grid(s):
    return blend.simplex(s, MODELS)


_MEASURES = ", ".join(_r(c, c) for c in ("wape", "bias_ratio", "improvement", "spread", "won", "objective", *[f"w_{m}" for m in MODELS]))
_add("ens8_grid_search", lambda s, d: mixtures.search(base._oof(s, d), MODELS, _grid(s), "baseline"), f"{_SUMS}, {_search_sql('g', '', 0.06, 0.03)} SELECT candidate, CAST(n AS BIGINT) AS n, {_MEASURES} FROM g")
_add("ens8_random_search", lambda s, d: mixtures.search(base._oof(s, d), MODELS, mixtures.drawn_candidates(s, MODELS, 400), "baseline"), None)


def _plan_sql(key: str, stability: float, bias: float, prior: float, most: float) -> str:
    k = f"least({most}, l.n / (l.n + {prior}))"
    mixed = {m: f"({k} * l.w_{m} + (1 - {k}) * g.w_{m})" for m in MODELS}
    total = " + ".join(mixed.values())
    return f"{_search_sql('g', '', 0.06, 0.03)}, {_search_sql('l', key, stability, bias)}, plan AS (SELECT l.{key}, l.n, {', '.join(f'{v} / ({total}) AS w_{m}' for m, v in mixed.items())} FROM l, g)"


_HORIZON, _PRODUCT = _plan_sql("horizon", 0.0, 0.01, 500.0, 1.0), _plan_sql("product_id", 0.02, 0.02, 180.0, 0.75)
_PLAN_COLUMNS = "CAST(n AS BIGINT) AS n, " + ", ".join(_r(f"w_{m}", f"w_{m}") for m in MODELS)
_add("ens9_horizon_plan", lambda s, d: mixtures.horizon_plan(base._oof(s, d), MODELS, _grid(s), "baseline"), f"{_SUMS}, {_HORIZON} SELECT horizon, {_PLAN_COLUMNS} FROM plan")
_add("ens10_product_plan", lambda s, d: mixtures.product_plan(base._oof(s, d), MODELS, _grid(s), "baseline"), f"{_SUMS}, {_PRODUCT} SELECT product_id, {_PLAN_COLUMNS} FROM plan")


def _four_methods(s, d):
    """The four kinds of plan, applied to the same rows."""
    oof, grid = written(base._oof(s, d)), _grid(s)
    overall = mixtures.search(oof, MODELS, grid, "baseline")
    flat = mixtures.apply_plan(oof, MODELS, overall, name="global_convex")
    scales = blend.reconciliation(flat.where("global_convex is not null"), "global_convex")
    out = mixtures.apply_plan(flat, MODELS, overall, scales=scales, name="aggregate_reconciled")
    out = mixtures.apply_plan(out, MODELS, overall, mixtures.horizon_plan(oof, MODELS, grid, "baseline"), "horizon", name="horizon_convex")
    out = mixtures.apply_plan(out, MODELS, overall, mixtures.product_plan(oof, MODELS, grid, "baseline"), "product_id", name="product_convex")
    return out.select("product_id", "origin", "horizon", "global_convex", "aggregate_reconciled", "horizon_convex", "product_convex")


_MIX = " + ".join(f"pred_{m} * {{0}}.w_{m}" for m in MODELS)
_HELD = "pred_baseline IS NOT NULL AND pred_seasonal_naive IS NOT NULL AND pred_moving_avg IS NOT NULL"
_add("ens12_four_methods", _four_methods, f"""{_SUMS}, {_search_sql('g', '', 0.06, 0.03)}, {_search_sql('h', 'horizon', 0.0, 0.01)}, {_search_sql('q', 'product_id', 0.02, 0.02)},
flat AS (SELECT o.*, CASE WHEN {_HELD} THEN greatest({_MIX.format('g')}, 0.0) END AS gc FROM oof o, g),
rs AS (SELECT horizon, sum(actual) AS a, sum(gc) AS p FROM flat WHERE available AND gc IS NOT NULL GROUP BY horizon), sc AS (SELECT horizon, least(greatest(1 + abs(a) / (abs(a) + 5000) * (a / nullif(p, 0) - 1), 0.85), 1.15) AS scale FROM rs),
hp AS (SELECT h.horizon, {', '.join(f'(h.n / (h.n + 500.0)) * h.w_{m} + (1 - h.n / (h.n + 500.0)) * g.w_{m} AS w_{m}' for m in MODELS)} FROM h, g),
qp AS (SELECT q.product_id, {', '.join(f'least(0.75, q.n / (q.n + 180.0)) * q.w_{m} + (1 - least(0.75, q.n / (q.n + 180.0))) * g.w_{m} AS w_{m}' for m in MODELS)} FROM q, g),
a AS (SELECT flat.product_id, origin, flat.horizon, gc, gc * coalesce(scale, 1.0) AS ar, CASE WHEN {_HELD} THEN greatest({' + '.join(f'pred_{m} * coalesce(hp.w_{m}, g.w_{m})' for m in MODELS)}, 0.0) END AS hc, CASE WHEN {_HELD} THEN greatest({' + '.join(f'pred_{m} * coalesce(qp.w_{m}, g.w_{m})' for m in MODELS)}, 0.0) END AS pc
FROM flat LEFT JOIN sc ON sc.horizon = flat.horizon LEFT JOIN hp ON hp.horizon = flat.horizon LEFT JOIN qp ON qp.product_id = flat.product_id, g)
SELECT product_id, origin, horizon, {_r('gc', 'global_convex')}, {_r('ar', 'aggregate_reconciled')}, {_r('hc', 'horizon_convex')}, {_r('pc', 'product_convex')} FROM a""")
_DEV, _BENCH = ORIGINS[:5], ORIGINS[5:]


def _at(origins):
    return F.col("origin").isin([F.lit(o).cast("date") for o in origins])


def _confirmed(s, d):
    oof = base._oof(s, d)
    return mixtures.fit_and_confirm(oof.where(_at(_DEV)), oof.where(_at(_BENCH)), MODELS)


def _coef(name: str, origins) -> str:
    dates = ", ".join(f"DATE '{o}'" for o in origins)
    return f"""{name}k AS (SELECT *, {_STRATUM} AS stratum FROM oof WHERE origin IN ({dates}) AND available AND actual IS NOT NULL AND {_HELD}),
{name}v AS (SELECT stratum, sum(abs(actual)) AS volume, CASE stratum WHEN 'winter' THEN 0.6 WHEN 'regular' THEN 0.25 ELSE 0.15 END::DOUBLE AS w FROM {name}k GROUP BY stratum HAVING sum(abs(actual)) > 0),
{name} AS (SELECT {name}k.*, w / (SELECT sum(w) FROM {name}v) / volume AS coef FROM {name}k JOIN {name}v USING (stratum))"""


_FITTED = f"""{_OOF}, {_GRID10}, {_coef('dev', _DEV)}, {_coef('ben', _BENCH)},
sc AS (SELECT candidate, w_baseline, w_seasonal_naive, w_moving_avg, sum(coef * abs({_MIX.format('grid')} - actual)) AS aligned, sum(abs({_MIX.format('grid')} - actual)) / sum(abs(actual)) AS broad, any_value(w_baseline * w_baseline + w_seasonal_naive * w_seasonal_naive + w_moving_avg * w_moving_avg) AS conc FROM dev, grid GROUP BY ALL),
won AS (SELECT * FROM sc ORDER BY round(sc.aligned, 12), conc, candidate LIMIT 1),
one AS (SELECT CASE WHEN w_baseline = 1 THEN 'baseline' WHEN w_seasonal_naive = 1 THEN 'seasonal_naive' ELSE 'moving_avg' END AS best_single, aligned AS sa, CASE WHEN w_baseline = 1 THEN 0 WHEN w_seasonal_naive = 1 THEN 1 ELSE 2 END AS pl FROM sc WHERE conc = 1 ORDER BY round(sc.aligned, 12), pl LIMIT 1),
ev AS (SELECT sum(coef * abs(greatest({_MIX.format('won')}, 0.0) - actual)) AS ba, sum(coef * abs(CASE best_single WHEN 'baseline' THEN pred_baseline WHEN 'seasonal_naive' THEN pred_seasonal_naive ELSE pred_moving_avg END - actual)) AS sb, count(*) AS nb FROM ben, won, one),
fin AS (SELECT *, coalesce((sa - aligned) / nullif(sa, 0), 0.0) AS improvement, (ba - sb) / nullif(sb, 0) AS change FROM won, one, ev)"""
_add("ens6_fit_and_confirm", _confirmed, f"{_FITTED} SELECT candidate, {', '.join(_r(f'w_{m}', f'w_{m}') for m in MODELS)}, {_r('aligned', 'development_aligned')}, {_r('broad', 'development_broad')}, best_single, {_r('sa', 'single_development_aligned')}, {_r('ba', 'benchmark_aligned')}, {_r('sb', 'single_benchmark_aligned')}, nb AS n_benchmark, {_r('improvement', 'improvement')}, {_r('change', 'benchmark_change')}, coalesce(change <= 0.02, false) AS confirmed, coalesce(improvement >= 0.002 AND change <= 0.02, false) AS accepted FROM fin")
_EVAL = "e AS (SELECT *, quantile_cont(actual, 0.9) OVER () AS cut FROM {0} WHERE available AND actual IS NOT NULL AND {1} IS NOT NULL AND {2} IS NOT NULL), v AS (SELECT count(*) AS n, sum(abs({1} - actual)) / nullif(sum(abs(actual)), 0) AS wape, sum({1} - actual) / nullif(sum(abs(actual)), 0) AS bias_ratio, sum(abs({2} - actual)) / nullif(sum(abs(actual)), 0) AS reference_wape, sum(abs({1} - actual)) FILTER (WHERE actual >= cut) / nullif(sum(abs(actual)) FILTER (WHERE actual >= cut), 0) AS top_wape, sum(abs({2} - actual)) FILTER (WHERE actual >= cut) / nullif(sum(abs(actual)) FILTER (WHERE actual >= cut), 0) AS reference_top_wape FROM e)"
_add("ens15_evaluation", lambda s, d: mixtures.evaluation(base._oof(s, d), "pred_moving_avg", "pred_baseline"), f"{_OOF}, {_EVAL.format('oof', 'pred_moving_avg', 'pred_baseline')} SELECT n, {', '.join(_r(c, c) for c in ('wape', 'bias_ratio', 'reference_wape', 'top_wape', 'reference_top_wape'))}, {_r('(reference_wape - wape) / nullif(reference_wape, 0)', 'improvement')}, {_r('(top_wape - reference_top_wape) / nullif(reference_top_wape, 0)', 'top_change')} FROM v")
_add("ens15_by_stratum", lambda s, d: mixtures.by_stratum(base._oof(s, d), "pred_moving_avg", "pred_baseline"), f"{_OOF}, k AS (SELECT *, {_STRATUM} AS stratum FROM oof WHERE available AND actual IS NOT NULL AND pred_moving_avg IS NOT NULL AND pred_baseline IS NOT NULL), g AS (SELECT stratum, sum(abs(pred_moving_avg - actual)) / nullif(sum(abs(actual)), 0) AS wape, sum(abs(pred_baseline - actual)) / nullif(sum(abs(actual)), 0) AS reference_wape FROM k GROUP BY stratum) SELECT stratum, {_r('wape', 'wape')}, {_r('reference_wape', 'reference_wape')}, {_r('(wape - reference_wape) / nullif(reference_wape, 0)', 'change')} FROM g")


def _evidence(s, d):
    """Both other members as candidates against the baseline."""
    oof, out = base._oof(s, d), None
    for m in MODELS[1:]:
        e = mixtures.evaluation(oof, f"pred_{m}", "pred_baseline").select(F.lit(m).alias("candidate"), "improvement", "top_change")
        holiday = mixtures.by_stratum(oof, f"pred_{m}", "pred_baseline").agg(F.max(F.when(F.col("stratum") == "holiday", F.col("change"))).alias("holiday_change"))
        sure = select.bootstrap(select.block_totals(oof, "pred_baseline", f"pred_{m}")).select("p_positive")
        one = e.crossJoin(F.broadcast(holiday)).crossJoin(F.broadcast(sure))  # one row each
        out = one if out is None else out.unionByName(one)
    return mixtures.gates(out)


def _gate_sql(m: str) -> str:
    p = f"pred_{m}"
    return f"""SELECT '{m}' AS candidate, improvement, top_change, holiday_change, p_positive FROM (WITH x AS (SELECT *, quantile_cont(actual, 0.9) OVER () AS cut, {_STRATUM} AS stratum FROM oof WHERE available AND actual IS NOT NULL AND {p} IS NOT NULL AND pred_baseline IS NOT NULL),
w AS (SELECT sum(abs({p} - actual)) AS e, sum(abs(pred_baseline - actual)) AS r, sum(abs({p} - actual)) FILTER (WHERE actual >= cut) AS te, sum(abs(pred_baseline - actual)) FILTER (WHERE actual >= cut) AS tr, sum(abs({p} - actual)) FILTER (WHERE stratum = 'holiday') AS he, sum(abs(pred_baseline - actual)) FILTER (WHERE stratum = 'holiday') AS hr FROM x),
tot AS (SELECT origin, sum(abs(pred_baseline - actual)) AS ref, sum(abs({p} - actual)) AS cand FROM x GROUP BY origin), num AS (SELECT *, row_number() OVER (ORDER BY origin) - 1 AS pos FROM tot), n AS (SELECT count(*) AS n FROM num),
picks AS (SELECT draw, CAST(concat('0x', substr(md5(concat(draw, '-', place)), 1, 8)) AS BIGINT) % n AS pos FROM n, range(1, 501) a(draw), range(1, 1000) b(place) WHERE place <= n), gg AS (SELECT draw, 1 - sum(cand) / nullif(sum(ref), 0) AS gain FROM picks JOIN num USING (pos) GROUP BY draw)
SELECT 1 - e / r AS improvement, te / tr - 1 AS top_change, he / hr - 1 AS holiday_change, (SELECT avg(CAST(gain > 0 AS INT)) FROM gg) AS p_positive FROM w)"""


_GATED = f"{_OOF}, ev AS ({' UNION ALL '.join(_gate_sql(m) for m in MODELS[1:])}), gt AS (SELECT *, improvement >= 0.002 AS passes_development, top_change <= 0.02 AS passes_top, coalesce(holiday_change, 0.0) <= 0.03 AS passes_holiday, p_positive >= 0.75 AS passes_bootstrap, improvement - 0.10 * greatest(top_change, 0.0) - 0.10 * greatest(coalesce(holiday_change, 0.0), 0.0) AS score FROM ev)"
_add("sel10_gates", _evidence, f"{_GATED} SELECT candidate, {_r('improvement', 'improvement')}, {_r('top_change', 'top_change')}, {_r('holiday_change', 'holiday_change')}, {_r('p_positive', 'p_positive')}, passes_development, passes_top, passes_holiday, passes_bootstrap, {_r('score', 'score')}, coalesce(passes_development AND passes_top AND passes_holiday AND passes_bootstrap, false) AS accepted FROM gt")
_add("sel10_winner", lambda s, d: mixtures.winner(_evidence(s, d)), f"{_GATED}, c AS (SELECT candidate, score, 0 AS o FROM gt WHERE passes_development AND passes_top AND passes_holiday AND passes_bootstrap UNION ALL SELECT 'control', 0.0, 1) SELECT candidate, {_r('c.score', 'score')} FROM c ORDER BY o, round(c.score, 12) DESC, candidate LIMIT 1")


def _members(s, d):
    flat = base._oof(s, d)
    keys = ["product_id", "origin", "horizon"]
    again = decisions._recursive(s, d).select(*keys, "pred")
    return mixtures.merged({"direct": flat.where("horizon <= 5").select(*keys, F.col("pred_moving_avg").alias("pred")), "recursive": again}, keys)


_add("jn9_merged_members", _members, f"{decisions._REC} SELECT o.product_id, o.origin, o.horizon, {_r('o.pred_moving_avg', 'pred_direct')}, {_r('r.pred', 'pred_recursive')} FROM oof o JOIN rec r USING (product_id, origin, horizon) WHERE o.horizon <= 5")
_add("mdl15_meta_features", lambda s, d: mixtures.meta_features(mixtures.known(base._oof(s, d), MODELS), MODELS).select("product_id", "origin", "horizon", "member_mean", "member_std", "member_range", "month_sin", "weekday_cos", "delta_moving_avg", "relative_delta_seasonal_naive"), f"{_OOF}, k AS (SELECT * FROM oof WHERE available AND actual IS NOT NULL AND {_HELD}) SELECT product_id, origin, horizon, {_r('(pred_baseline + pred_seasonal_naive + pred_moving_avg) / 3', 'member_mean')}, {_r('sqrt((pow(pred_baseline - (pred_baseline + pred_seasonal_naive + pred_moving_avg) / 3, 2) + pow(pred_seasonal_naive - (pred_baseline + pred_seasonal_naive + pred_moving_avg) / 3, 2) + pow(pred_moving_avg - (pred_baseline + pred_seasonal_naive + pred_moving_avg) / 3, 2)) / 2)', 'member_std')}, {_r('greatest(pred_baseline, pred_seasonal_naive, pred_moving_avg) - least(pred_baseline, pred_seasonal_naive, pred_moving_avg)', 'member_range')}, {_r('sin(month(target_date) * 2 * pi() / 12)', 'month_sin')}, {_r('cos((isodow(target_date) - 1) * 2 * pi() / 7)', 'weekday_cos')}, {_r('pred_moving_avg - pred_baseline', 'delta_moving_avg')}, {_r('(pred_seasonal_naive - pred_baseline) / (abs(pred_baseline) + 1)', 'relative_delta_seasonal_naive')} FROM k")


def _gated_blend(s, d):
    """The moving average's gate, opened by its advantage at the product's other origins."""
    k = mixtures.known(base._oof(s, d), MODELS).withColumn("gain", F.abs(F.col("actual") - F.col("pred_baseline")) - F.abs(F.col("actual") - F.col("pred_moving_avg")))
    other = k.groupBy("product_id", "origin").agg(F.sum("gain").alias("own"), F.count("*").alias("n"))
    total = other.groupBy("product_id").agg(F.sum("own").alias("all"), F.sum("n").alias("all_n"))
    advantage = other.join(total, "product_id").select("product_id", "origin", F.coalesce((F.col("all") - F.col("own")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0)), F.lit(0.0)).alias("advantage"))
    rows = k.join(advantage, ["product_id", "origin"]).crossJoin(F.broadcast(mixtures.advantage_scale(k, "pred_baseline", "pred_moving_avg")))  # one row
    return rows.select("product_id", "origin", "horizon", "advantage", "scale", mixtures.gate_blend(F.col("pred_baseline"), F.col("pred_moving_avg"), F.col("advantage"), F.col("scale")).alias("blend"))


_add("mdl14_gate_blend", _gated_blend, f"""{_OOF}, k AS (SELECT *, abs(actual - pred_baseline) - abs(actual - pred_moving_avg) AS gain FROM oof WHERE available AND actual IS NOT NULL AND {_HELD}),
o AS (SELECT product_id, origin, sum(gain) AS own, count(*) AS n FROM k GROUP BY 1, 2), a AS (SELECT product_id, origin, coalesce((sum(own) OVER (PARTITION BY product_id) - own) / nullif(sum(n) OVER (PARTITION BY product_id) - n, 0), 0.0) AS advantage FROM o),
s AS (SELECT greatest(coalesce(quantile_cont(gain, 0.75) FILTER (WHERE gain > 0), quantile_cont(abs(gain), 0.75)), 1.0) AS scale FROM k)
SELECT product_id, origin, horizon, {_r('advantage', 'advantage')}, {_r('scale', 'scale')}, {_r('greatest(pred_baseline + 0.75 * greatest(0.0, least(1.0, advantage / greatest(scale, 1e-6))) * (pred_moving_avg - pred_baseline), 0.0)', 'blend')} FROM k JOIN a USING (product_id, origin), s""")

# small operators --------------------------------------------------------------------------------------------------

_add("prj24_candidate_ids", lambda s, d: blend.fit(base._oof(s, d), MODELS).select("candidate", scalar.candidate_id(F.struct("candidate")).alias("id")), f"{base._FIT} SELECT candidate, substr(sha256('{{\"candidate\":\"' || candidate || '\"}}'), 1, 12) AS id FROM f")
_add("srt3_display_order", lambda s, d: evaluate.in_display_order(base._long(s, d).where("common").groupBy("model").agg(F.count("*").alias("n"))), f"{_OOF}, m AS (SELECT model, count(*) AS n FROM long WHERE common GROUP BY model) SELECT model, n, row_number() OVER (ORDER BY CASE model WHEN 'baseline' THEN 8 WHEN 'seasonal_naive' THEN 9 WHEN 'moving_avg' THEN 10 ELSE 11 END, model) AS place FROM m")


def _supported(s, d):
    long = base._long(s, d).withColumn("strategy", F.lit("direct"))
    lists = s.createDataFrame([("baseline", "direct"), ("moving_avg", "direct"), ("moving_avg", "recursive"), ("seasonal_naive", "recursive")], "model string, strategy string")
    return evaluate.supported(long, lists).groupBy("model", "strategy").agg(F.count("*").alias("n"), F.count("pred").alias("known"))


_add("mdl10_supported", _supported, f"{_OOF} SELECT model, 'direct' AS strategy, count(*) AS n, count(pred) AS known FROM long WHERE model IN ('baseline', 'moving_avg') GROUP BY model")


def _canonical(s, d):
    return base._filled(s, d).select("product_id", "date_key", *[v.alias(k) for k, v in scalar.context_calendar().items()], *[scalar.canonical(F.col(c)).alias(c) for c in ("campaign_web", "campaign_app", "is_promo")])


_add("prj19_context_columns", _canonical, f"{base._FILLED} SELECT product_id, date_key, {_r('sin((isodow(date_key) - 1) * 2 * pi() / 7)', 'weekday_sin')}, {_r('cos((isodow(date_key) - 1) * 2 * pi() / 7)', 'weekday_cos')}, {_r('sin(month(date_key) * 2 * pi() / 12)', 'month_sin')}, {_r('cos(month(date_key) * 2 * pi() / 12)', 'month_cos')}, coalesce(CAST(campaign_web AS VARCHAR), 'missing') AS campaign_web, coalesce(CAST(campaign_app AS VARCHAR), 'missing') AS campaign_app, coalesce(CAST(is_promo AS VARCHAR), 'missing') AS is_promo FROM filled")


def _kept_first(s, d):
    """Of the grid's candidates with the same active members, the first by name."""
    rows = blend.fit(base._oof(s, d), MODELS)
    active = F.concat_ws("+", *[F.when(F.col(f"w_{m}") > 0, F.lit(m)) for m in MODELS])
    return select.keep_first(rows.withColumn("active", active), ["active"], "candidate").select("active", "candidate", "broad")


_ACTIVE = "concat_ws('+', " + ", ".join(f"CASE WHEN w_{m} > 0 THEN '{m}' END" for m in MODELS) + ")"
_add("set3_keep_first", _kept_first, f"{base._FIT}, a AS (SELECT *, {_ACTIVE} AS active, row_number() OVER (PARTITION BY {_ACTIVE} ORDER BY candidate) AS place FROM f) SELECT active, candidate, {_r('broad', 'broad')} FROM a WHERE place = 1")
_add("set5_jn13_unused_days", lambda s, d: select.unused(base._filled(s, d).select("date_key").distinct(), direct.direct_panel(base._state(s, d), 1, origins=ORIGINS).select(F.col("target_date").alias("date_key")), ["date_key"]), f"{_OOF} SELECT DISTINCT date_key FROM filled WHERE date_key NOT IN (SELECT CAST(origin + 1 AS DATE) FROM oof WHERE horizon = 1)")


def _paired_candidates(s, d):
    oof = base._oof(s, d)
    keys = ["product_id", "target_date", "origin"]
    return select.side_by_side(oof.select(*keys, "actual", F.col("pred_baseline").alias("pred")), oof.where("available").select(*keys, F.col("pred_moving_avg").alias("pred")), keys)


_add("jn10_control_candidate", _paired_candidates, f"{_OOF} SELECT product_id, target_date, origin, {_r('actual', 'actual')}, {_r('pred_baseline', 'control')}, {_r('pred_moving_avg', 'candidate')} FROM oof WHERE available")


def _seed_pairs(s, d):
    """Daily scores of three baselines of the residual, as three seeds of one detector: all pairs' agreement."""
    rows = base._state(s, d).withColumns({f"b{i}": direct.baseline(v) for i, v in enumerate(("w4321", "w8421", "lag7"))})
    long = rows.select("date_key", F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.abs(F.log1p("qty_available") - F.log1p(f"b{i}")).alias("x")) for i in range(3)])).alias("p"))
    daily = long.groupBy("date_key", "p.seed").agg(F.avg("p.x").alias("score"))
    return select.seed_pairs(daily).groupBy("seed_a", "seed_b").agg(F.count("*").alias("days"), F.corr("score_a", "score_b").alias("agreement"))


_add("jn12_seed_pairs", _seed_pairs, f"{base._LAGGED}, e AS (SELECT date_key, 0 AS seed, avg(abs(ln(1 + qty_available) - ln(1 + b4321))) AS score FROM based GROUP BY 1 UNION ALL SELECT date_key, 1, avg(abs(ln(1 + qty_available) - ln(1 + b8421))) FROM based GROUP BY 1 UNION ALL SELECT date_key, 2, avg(abs(ln(1 + qty_available) - ln(1 + l7))) FROM based GROUP BY 1), k AS (SELECT * FROM e WHERE score IS NOT NULL) SELECT CAST(a.seed AS BIGINT) AS seed_a, CAST(b.seed AS BIGINT) AS seed_b, count(*) AS days, {_r('corr(a.score, b.score)', 'agreement')} FROM k a JOIN k b ON a.date_key = b.date_key AND a.seed < b.seed GROUP BY 1, 2")


def _seeds_reduced(s, d):
    """Three members as seeds of one model: the mean over the finite ones."""
    oof = base._oof(s, d)
    return oof.select("product_id", "origin", "horizon", *[v.alias(k) for k, v in models.seed_mean([F.col(f"pred_{m}") for m in MODELS]).items()])


_LIST = "list_filter([pred_baseline, pred_seasonal_naive, pred_moving_avg], lambda x: x IS NOT NULL)"
_add("pnl10_seed_mean", _seeds_reduced, f"{_OOF}, s AS (SELECT *, {_LIST} AS a FROM oof) SELECT product_id, origin, horizon, {_r('CASE WHEN len(a) > 0 THEN greatest(list_avg(a), 0.0) END', 'pred')}, {_r('list_min(a)', 'raw_min')}, {_r('list_max(a)', 'raw_max')}, len(a) < 3 AS any_nonfinite FROM s")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
