"""Registered queries of context risk, models on top of forecasts and step-by-step selections. SQL stands where it gives
the same rows: the sums that fits and choices are made of; the fits themselves are held against refits in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside import catalog_evidence as evidence
from quayside import catalog_reports as reports
from quayside.catalog import _OOF, _SCORED, MODELS, ORIGINS, _r
from quayside.operators import anomaly, audit, blend, forest, mixtures, select, selection
from quayside.plans import direct, meta, models, walk
from quayside.sources import panel as source
from quayside.sources import sinks
from quayside.sources.shared import written

_Q: dict = {}
_SQL: dict[str, str] = {}
_ENDS = evidence._ENDS


def _add(name: str, query, sql: str | None = None) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    if sql:
        _SQL[name] = sql


_KNOWN = "available AND actual IS NOT NULL AND " + " AND ".join(f"pred_{m} IS NOT NULL" for m in MODELS)

# context risk -------------------------------------------------------------------------------------------------------


def _context_risk(s, d):
    """Learned from the days up to 2000, scored on the days after."""
    rows = base._filled(s, d)
    risk = forest.fit(rows.where("date_key <= DATE '2000-12-31'"))
    return risk.score(rows.where("date_key > DATE '2000-12-31'"))


_add("mdl16_context_forest", lambda s, d: _context_risk(s, d).select("product_id", "date_key", "context_risk_raw", "context_risk_percentile", "context_shift_flag"))
_add("agg19_forest_risk_by_day", lambda s, d: audit.risk_rollup(_context_risk(s, d).withColumnRenamed("context_risk_percentile", "risk")))

# models on top of forecasts -----------------------------------------------------------------------------------------

_GRAM = ["pred_baseline", "pred_moving_avg", "horizon", "residual"]


def _gram_sums(s, d):
    """Sums of products of four columns and 1 by origin: what a fold's ridge is solved from."""
    rows = mixtures.known(base._oof(s, d), MODELS).withColumn("residual", F.col("actual") - F.col("pred_baseline"))
    return meta.gram(rows, _GRAM, "origin")


_PAIRS = [(i, j) for i in range(len(_GRAM) + 1) for j in range(i, len(_GRAM) + 1)]
_COLUMN = ["1.0", *_GRAM]
_add(
    "mdl12_gram_sums",
    _gram_sums,
    f"{_OOF}, k AS (SELECT *, actual - pred_baseline AS residual FROM oof WHERE {_KNOWN}) "
    + " UNION ALL ".join(f"SELECT origin, {i} AS i, {j} AS j, {_r(f'sum({_COLUMN[i]} * {_COLUMN[j]})', 'total')} FROM k GROUP BY origin" for i, j in _PAIRS),
)
_KEYS = ["product_id", "origin", "horizon"]
_add("mdl12_residual_stacker", lambda s, d: meta.stacked(base._oof(s, d), MODELS, "baseline").select(*_KEYS, "actual", "pred_baseline", "stacked"))


def _recent(s, d):
    """The last three origins: a fit for each of them."""
    return written(base._oof(s, d)).where(F.col("origin").isin([F.lit(o).cast("date") for o in ORIGINS[-3:]]))


_add("mdl13_risk_gate", lambda s, d: meta.risk_gate(_recent(s, d), MODELS, "baseline", trees=8, step=0.3).select(*_KEYS, "pred_baseline", "gated"))
_add("mdl14_learned_gate", lambda s, d: meta.specialist_gate(_recent(s, d), "baseline", "moving_avg", trees=8, step=0.3).select(*_KEYS, "predicted_advantage", "scale", "alpha", "blend"))

# selections ---------------------------------------------------------------------------------------------------------

_MOMENTS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i:]]
_add(
    "sel9_residual_moments",
    lambda s, d: selection.co_moments(base._oof(s, d), MODELS),
    f"{_OOF}, k AS (SELECT {', '.join(f'actual - pred_{m} AS {m}' for m in MODELS)} FROM oof WHERE {_KNOWN}) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {_r(f'covar_pop({a}, {b})', 'covariance')} FROM k" for a, b in _MOMENTS),
)
_FAMILIES = {"baseline": "control", "seasonal_naive": "lag", "moving_avg": "statistical"}
_add("sel9_diverse_members", lambda s, d: selection.diverse_members(base._oof(s, d), MODELS, "baseline", _FAMILIES, 2))

#: Columns of a direct panel by group: the control's, and those that a selection may add.
_BASE = ["x_lag_0", "x_target_baseline"]
_GROUPS = {
    "seasons": ["x_season_7", "x_season_14", "x_season_21", "x_season_28"], "year": ["x_annual", "missing_annual"], "calendar": ["weekday_sin", "weekday_cos", "month_sin", "month_cos"],
    "promotion": ["promo", "x_discount_web", "x_discount_app"], "price": ["price_vs_origin", "price_vs_median_28"],
}


def _feature_rows(s, d):
    """Known numbers of a panel with prices: log1p of quantities and discounts, nulls 0."""
    from quayside.functions.scalar import context_calendar

    panel = models.features(direct.direct_panel(base._state(s, d), price=True))
    zero = lambda c: F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c), F.lit(0.0))
    columns = {c: v for c, v in context_calendar("target_date").items()}
    columns |= {"promo": F.col("is_promo").cast("double"), "x_discount_web": F.log1p(F.greatest("discount_web", F.lit(0.0))), "x_discount_app": F.log1p(F.greatest("discount_app", F.lit(0.0)))}
    out = panel.withColumns(columns)
    every = [*_BASE, *[c for own in _GROUPS.values() for c in own]]
    return out.withColumns({c: zero(F.col(c).cast("double")) for c in every})


def _forward(s, d):
    """Groups added to a ridge on log residuals, judged on the last three origins."""
    rows = written(_feature_rows(s, d))
    cutoff = ORIGINS[-4]
    train = direct.recency_weights(direct.trainable(rows, cutoff), cutoff, 365).where("label is not null")
    train = train.withColumn("age", F.datediff(F.lit(cutoff).cast("date"), "target_date").cast("double"))
    held = rows.where(F.col("origin").isin([F.lit(o).cast("date") for o in ORIGINS[-3:]]) & F.col("available") & F.col("target").isNotNull())
    return selection.forward_groups(train, held.withColumnRenamed("target", "actual"), _BASE, _GROUPS, half_lives=(180.0, 730.0))


_add("sel6_forward_groups", _forward)



def _anomaly_ridge(s, d):
    """A ridge on the residual panel without and with the origin's anomaly state, on the same rows."""
    from quayside.functions.scalar import finite

    state = base._state(s, d)
    rows = mixtures.residual_panel(state, anomaly.profile(state)).where("available and target is not null and weighted_baseline is not null")
    known = ["lag_0", "mean_7", "mean_28", "price", "horizon"]
    extra = [f"origin_{c}" for c in anomaly.ORIGIN_COLUMNS]
    number = lambda c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0))
    rows = rows.withColumns({f"x_{c}": F.log1p(F.greatest(number(c), F.lit(0.0))) if c not in extra else number(c) for c in [*known, *extra]})
    rows = written(rows.withColumns({"target_baseline": F.col("weighted_baseline"), "label": F.log1p("target") - F.log1p("weighted_baseline"), "sample_weight": F.lit(1.0)}))
    cutoff = F.lit(ORIGINS[-3]).cast("date")
    held = rows.where(F.col("origin").isin([F.lit(o).cast("date") for o in ORIGINS[-3:]])).withColumnRenamed("target", "actual")
    return selection.forward_groups(rows.where(F.col("target_date") <= cutoff), held, [f"x_{c}" for c in known], {"anomaly": [f"x_{c}" for c in extra]})


_add("mdl11_anomaly_ridge", lambda s, d: _anomaly_ridge(s, d).where("label in ('control', 'single_anomaly')").select("label", "aligned", "broad", "bias_ratio"))

# daily detectors by seed --------------------------------------------------------------------------------------------


def _seed_days(s, d):
    return written(audit.seed_scores(anomaly.scores(base._state(s, d)), _ENDS))


def _hard(s, d):
    return written(audit.difficulty(base._state(s, d)))


_SEEDS = f"""{_SCORED},
drawn AS (SELECT seed, s.* FROM scored s, range(1, 4) r(seed) WHERE CAST(concat('0x', substr(md5(concat(seed, '-', product_id)), 1, 8)) AS BIGINT) % 4 < 3),
seed_day AS (SELECT seed, date_key, quantile_cont(score, 0.9) AS score, bool_or(known_event) AS any_event FROM drawn GROUP BY seed, date_key),
seed_daily AS (SELECT *, CASE WHEN date_key <= DATE '{_ENDS[0]}' THEN 'train' WHEN date_key <= DATE '{_ENDS[1]}' THEN 'validation' WHEN date_key <= DATE '{_ENDS[2]}' THEN 'calibration' ELSE 'holdout' END AS split FROM seed_day)"""


def _ranks(name: str, rows: str, by: str, a: str, b: str, out: str) -> str:
    """Rank correlation of a and b by group."""
    place = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY {by}, round({c}, 9)) - 1) / 2.0"
    return f"""{name}0 AS (SELECT {by}, {place(a)} AS ra, {place(b)} AS rb FROM ({rows}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
{name} AS (SELECT {by}, CASE WHEN isfinite(corr(ra, rb)) THEN corr(ra, rb) ELSE 0.0 END AS {out} FROM {name}0 GROUP BY {by})"""


_METRICS = f"""{_SEEDS}, {evidence._HARD},
s_cut AS (SELECT seed, quantile_cont(score, 0.98) AS threshold FROM seed_daily WHERE split = 'calibration' GROUP BY seed),
s_fl AS (SELECT seed_daily.*, CAST(score > threshold AS INT) AS flag FROM seed_daily JOIN s_cut USING (seed)),
s_rates AS (SELECT seed, abs(avg(flag) FILTER (WHERE split = 'calibration') - 0.02) AS cf, abs(avg(flag) FILTER (WHERE split = 'holdout') - 0.02) AS hf,
  (coalesce(avg(flag) FILTER (WHERE split = 'holdout' AND any_event), 0.0) + 1e-4) / (coalesce(avg(flag) FILTER (WHERE split = 'holdout' AND NOT any_event), 0.0) + 1e-4) AS ee FROM s_fl GROUP BY seed),
s_ho AS (SELECT *, CAST(date_key - DATE '1970-01-01' AS DOUBLE) AS day_no, lag(score) OVER (PARTITION BY seed ORDER BY date_key) AS before FROM s_fl WHERE split = 'holdout' AND score IS NOT NULL),
{_ranks("s_dr", "SELECT * FROM s_ho", "seed", "day_no", "score", "drift")},
s_pe AS (SELECT seed, CASE WHEN count(*) > 3 AND isfinite(corr(score, before)) THEN corr(score, before) ELSE 0.0 END AS persistence FROM s_ho GROUP BY seed),
s_bo AS (SELECT s_ho.*, difficulty FROM s_ho JOIN hard USING (date_key) WHERE difficulty IS NOT NULL),
{_ranks("s_pr", "SELECT * FROM s_bo", "seed", "score", "difficulty", "predictive")},
s_tp AS (SELECT seed, quantile_cont(score, 0.9) AS top, count(*) AS n, avg(difficulty) AS usual FROM s_bo GROUP BY seed),
s_li AS (SELECT seed, any_value(n) AS n_holdout, CASE WHEN any_value(n) >= 20 THEN coalesce(avg(difficulty) FILTER (WHERE score >= top) / nullif(any_value(usual), 0), 1.0) ELSE 1.0 END AS top_lift FROM s_bo JOIN s_tp USING (seed) GROUP BY seed),
s_me AS (SELECT seed, cf, hf, ee, coalesce(drift, 0.0) AS drift, coalesce(persistence, 0.0) AS persistence, coalesce(predictive, 0.0) AS predictive, n_holdout, coalesce(top_lift, 1.0) AS top_lift
  FROM s_rates LEFT JOIN s_dr USING (seed) LEFT JOIN s_pe USING (seed) LEFT JOIN s_pr USING (seed) LEFT JOIN s_li USING (seed))"""
_add(
    "anm12_seed_metrics",
    lambda s, d: audit.run_metrics(_seed_days(s, d), _hard(s, d)),
    f"{_METRICS} SELECT CAST(seed AS BIGINT) AS seed, {_r('cf', 'calibration_far_error')}, {_r('hf', 'holdout_far_error')}, {_r('ee', 'event_enrichment')}, {_r('s_me.drift', 'drift')}, "
    f"{_r('s_me.persistence', 'persistence')}, {_r('s_me.predictive', 'predictive')}, n_holdout, {_r('s_me.top_lift', 'top_lift')} FROM s_me",
)


def _objective(s, d):
    daily = _seed_days(s, d)
    return audit.diagnostic_objective(audit.run_metrics(daily, _hard(s, d)), daily)


_PAIRED = "SELECT a.seed AS seed_a, b.seed AS seed_b, a.score AS score_a, b.score AS score_b FROM seed_daily a JOIN seed_daily b ON a.date_key = b.date_key AND a.seed < b.seed"
_add(
    "anm13_diagnostic_objective",
    _objective,
    f"""{_METRICS}, {_ranks("s_ag", _PAIRED, "seed_a, seed_b", "score_a", "score_b", "agreement")},
s_sb AS (SELECT coalesce(avg(agreement), 1.0) AS stab, count(*) AS n_pairs FROM s_ag),
s_mm AS (SELECT count(*) AS n_seeds, greatest(-0.25, avg(predictive)) AS pc, tanh(greatest(0.0, avg(top_lift) - 1)) AS lc, 4.0 * (avg(cf) + avg(hf)) AS cp, 0.3 * abs(avg(drift)) AS dp, 0.2 * greatest(0.0, avg(persistence) - 0.85) AS pp FROM s_me)
SELECT n_seeds, n_pairs, {_r('pc', 'predictive_component')}, {_r('lc', 'lift_component')}, {_r('cp', 'calibration_penalty')}, {_r('dp', 'drift_penalty')}, {_r('pp', 'persistence_penalty')}, {_r('stab', 'seed_stability')},
  {_r('0.45 * pc + 0.20 * lc + 0.25 * stab - cp - dp - pp', 'objective')} FROM s_mm, s_sb""",
)

# walk-forward -------------------------------------------------------------------------------------------------------


def _wanted(s, strategies, origins):
    """The folds of all strategies at the origins, by the origins' stratum."""
    from quayside.functions.scalar import stratum

    dates = s.createDataFrame([(o,) for o in origins], "o string").select(F.col("o").cast("date").alias("origin"))
    return dates.select(F.explode(F.array(*map(F.lit, strategies))).alias("strategy"), stratum(F.col("origin")).alias("origin_type"), "origin")


def _store(s):
    import uuid

    from quayside.sources.shared import shared_dir

    return f"{shared_dir(s)}/folds-{uuid.uuid4().hex}"


def _stored_folds(s, d):
    """Two strategies at the last four origins: one run makes those of the winter, the next what is missing."""
    state, path = written(base._state(s, d)), _store(s)

    def naive(name):
        return lambda origin: direct.naive_forecasts(state, [origin]).withColumn("pred", F.col(f"pred_{name}")).select("product_id", "horizon", "target_date", "actual", "available", "pred")

    strategies = {m: naive(m) for m in ("baseline", "moving_avg")}
    wanted = _wanted(s, strategies, ORIGINS[-4:])
    walk.walk_stored(wanted.where("origin_type = 'winter'"), strategies, path)
    out = walk.walk_stored(wanted, strategies, path)
    return out.select("strategy", "origin_type", "origin", "product_id", "horizon", "target_date", "actual", "available", "pred")


_add(
    "snk3_pnl5_stored_folds",
    _stored_folds,
    f"{_OOF} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS strategy, {base._STRATUM} AS origin_type, origin, product_id, CAST(horizon AS BIGINT) AS horizon, target_date, {_r('actual', 'actual')}, available, {_r(f'pred_{m}', 'pred')} FROM oof WHERE origin IN ({', '.join(f'DATE {chr(39)}{o}{chr(39)}' for o in ORIGINS[-4:])})" for m in ("baseline", "moving_avg")
    ),
)


def _recursed(s, d):
    """One-step ridges at two origins, three days ahead, in three rounds for both."""
    state = written(base._state(s, d))
    return walk.forecast_origins(state, ORIGINS[-2:], walk.fitted_steps(state, ORIGINS[-2:], "ridge"), 3)


_add("pnl6_fitted_recursion", lambda s, d: _recursed(s, d).select("product_id", "origin", "horizon", "target_date", "pred", "fallback_used"))

# models of more inputs ----------------------------------------------------------------------------------------------


def _modelled(kind: str, inputs, trees: int = 10, seeds: tuple[int, ...] = (42,), wide: bool = False):
    def query(s, d):
        from quayside.plans import evaluate

        state = base._state(s, d)
        panel = written(models.wide_panel(state) if wide else direct.direct_panel(state))
        train = direct.recency_weights(direct.trainable(panel, ORIGINS[-2]), ORIGINS[-2], 365)
        held = panel.where(F.col("origin").isin([F.lit(o).cast("date") for o in ORIGINS[-2:]]))
        out = models.fit_predict(train, held, kind, trees, seeds, inputs).withColumnRenamed("target", "actual")
        return out.where(F.coalesce("available", F.lit(False))).groupBy("horizon").agg(*evaluate.metrics())

    return query


_add("mdl9_category_trees_of_10", _modelled("trees_a", models.CATEGORICAL))
_add("mdl3_fine_trees_of_10", _modelled("trees_b", models.CATEGORICAL))
_add("mdl1_prj22_wide_ridge", _modelled("ridge", models.WIDE, wide=True))

# report tables ------------------------------------------------------------------------------------------------------


def _blends(s, d):
    return blend.fit(base._oof(s, d), MODELS).select("candidate", F.col("aligned").alias("test_aligned_wape"), F.col("broad").alias("wape"), F.lit("blend").alias("model"))


def _screens(s, d):
    """Two screening tables in one schema; the best aligned candidate of each is the chosen one."""
    first, second = written(reports._screened(s, d)), written(_blends(s, d))
    best = lambda t: [t.orderBy(F.round("test_aligned_wape", 9), "candidate").first().candidate]
    return select.showcase([("baselines", first, best(first)), ("blends", second, best(second))])


_SCREEN = f"""SELECT 'baselines' AS tier, candidate, CAST(NULL AS VARCHAR) AS model, wape, test_aligned_wape, bias_ratio FROM ({reports._SQL['agg28_candidate_rows']})
UNION ALL SELECT 'blends', candidate, 'blend', broad, aligned, NULL FROM ({base._FIT} SELECT candidate, aligned, broad FROM f)"""
_add(
    "sel12_showcase",
    _screens,
    f"""WITH u AS ({_SCREEN}), c AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(test_aligned_wape, 9), candidate) = 1 AS selected FROM u)
SELECT tier, tier AS stage, candidate, model, {', '.join(_r(f'c.{x}', x) for x in ('wape', 'test_aligned_wape', 'bias_ratio'))}, CAST(NULL AS DOUBLE) AS coverage, '' AS description, selected,
  row_number() OVER (ORDER BY tier, selected DESC, round(c.test_aligned_wape, 9) NULLS LAST, candidate) AS place FROM c""",
)


def _stored_evidence(s, d):
    """Figures of a table that was stored earlier (four places; one was changed since, one is gone, one was added) against
    those that the rows give now."""
    rows = written(reports._screened(s, d).unpivot(["candidate"], [F.col("wape"), F.col("bias_ratio")], "measure", "value"))
    path = _store(s)
    value = F.round("value", 4) + F.when(F.col("candidate") == "lag7", 0.05).otherwise(0.0)
    ghost = s.createDataFrame([("ghost", "wape", 0.1)], "candidate string, measure string, value double")
    stated = rows.where("candidate <> 'median' or measure <> 'wape'").select("candidate", "measure", value.alias("value")).unionByName(ghost)
    sinks.write_tables({"evidence": stated}, path)
    return select.evidence_violations(source.read_artefact(s, f"{path}/evidence", "candidate string, measure string, value double"), rows)


_LONG = f"SELECT candidate, 'wape' AS measure, wape AS value FROM ({reports._SQL['agg28_candidate_rows']}) UNION ALL SELECT candidate, 'bias_ratio', bias_ratio FROM ({reports._SQL['agg28_candidate_rows']})"
_add(
    "sel13_stored_evidence",
    _stored_evidence,
    f"""WITH w AS ({_LONG}), st AS (SELECT candidate, measure, round(value, 4) + CASE WHEN candidate = 'lag7' THEN 0.05 ELSE 0.0 END AS value FROM w WHERE candidate <> 'median' OR measure <> 'wape' UNION ALL SELECT 'ghost', 'wape', 0.1),
j AS (SELECT coalesce(st.candidate, w.candidate) AS candidate, coalesce(st.measure, w.measure) AS measure, st.value AS stated, w.value AS derived, st.candidate IS NOT NULL AS is_stated, w.candidate IS NOT NULL AS is_derived FROM st FULL JOIN w ON st.candidate = w.candidate AND st.measure = w.measure),
v AS (SELECT *, CASE WHEN NOT is_derived THEN 'not derived' WHEN NOT is_stated THEN 'not stated' WHEN abs(stated - derived) > 5e-4 OR (stated IS NULL) <> (derived IS NULL) THEN 'differs' END AS violation FROM j)
SELECT candidate, measure, {_r('stated', 'stated')}, {_r('derived', 'derived')}, violation FROM v WHERE violation IS NOT NULL""",
)


def _gated(s, d):
    """The naive members through every gate: scores of the first five origins, the benchmark is the others."""
    oof = written(base._oof(s, d))
    dev, ben = (oof.where(F.col("origin").isin([F.lit(o).cast("date") for o in part])) for part in (ORIGINS[:5], ORIGINS[5:]))
    from quayside.plans import evaluate

    long = evaluate.long_form(dev, MODELS)
    y, p = F.col("actual"), F.col("pred")
    live = F.coalesce("available", F.lit(False)) & y.isNotNull()
    own = long.where(live).groupBy("model").agg((F.sum(F.abs(p - y)) / F.sum(F.when(p.isNotNull(), F.abs(y)))).alias("broad"), (F.count("pred") / F.count("*")).alias("coverage"))
    held = evaluate.long_form(ben, MODELS).where(live & F.col("common")).groupBy("model").agg((F.sum(F.abs(p - y)) / F.sum(F.abs(y))).alias("benchmark"))
    rows = own.join(evaluate.test_aligned(long), "model").join(held, "model").select(F.col("model").alias("candidate"), F.col("test_aligned_wape").alias("aligned"), "broad", "coverage", "benchmark")
    return select.gated(rows, F.col("candidate") == "baseline")


_IN = lambda part: ", ".join(f"DATE '{o}'" for o in part)
_GATES = f"""{_OOF}, all_rows AS ({' UNION ALL '.join(f"SELECT '{m}' AS candidate, origin, available, actual, pred_{m} AS pred, {_KNOWN} AS every FROM oof" for m in MODELS)}),
own AS (SELECT candidate, sum(abs(pred - actual)) / sum(abs(actual)) FILTER (WHERE pred IS NOT NULL) AS broad, count(pred) / count(*) AS coverage FROM all_rows WHERE available AND actual IS NOT NULL AND origin IN ({_IN(ORIGINS[:5])}) GROUP BY candidate),
st AS (SELECT candidate, {base._STRATUM} AS stratum, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape FROM all_rows WHERE every AND origin IN ({_IN(ORIGINS[:5])}) GROUP BY 1, 2),
al AS (SELECT candidate, sum(w * wape) / sum(w) AS aligned FROM (SELECT *, CASE stratum WHEN 'winter' THEN 0.6 WHEN 'regular' THEN 0.25 ELSE 0.15 END::DOUBLE AS w FROM st WHERE wape IS NOT NULL) GROUP BY candidate),
be AS (SELECT candidate, sum(abs(pred - actual)) / sum(abs(actual)) AS benchmark FROM all_rows WHERE every AND origin IN ({_IN(ORIGINS[5:])}) GROUP BY candidate),
g AS (SELECT * FROM own JOIN al USING (candidate) JOIN be USING (candidate)), ct AS (SELECT aligned AS ca, broad AS cb, benchmark AS cm FROM g WHERE candidate = 'baseline'),
h AS (SELECT g.*, candidate = 'baseline' OR coalesce(aligned <= 0.998 * ca, false) AS ps, coalesce(broad <= 1.03 * cb, false) AS pb, coalesce(coverage >= 0.999, false) AS pc, coalesce(benchmark <= 1.02 * cm, false) AS pm FROM g, ct)"""
_add(
    "sel4_5_all_gates",
    _gated,
    f"""{_GATES} SELECT candidate, {', '.join(_r(f'h.{x}', x) for x in ('aligned', 'broad', 'coverage', 'benchmark'))}, ps AS passes_score, pb AS passes_broad, pc AS passes_coverage, pm AS passes_benchmark, ps AND pb AND pc AND pm AS passes,
CASE WHEN ps AND pb AND pc AND pm THEN row_number() OVER (ORDER BY ps AND pb AND pc AND pm DESC, candidate = 'baseline', round(h.aligned, 12), candidate) END AS place FROM h""",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
