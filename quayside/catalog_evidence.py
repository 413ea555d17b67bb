"""Registered queries of daily evidence, models, further choices and report tables, with their SQL where it gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside import catalog_decisions as decisions
from quayside.catalog import _LAGGED, _OOF, _SCORED, _STATE, MODELS, _r
from quayside.functions import scalar
from quayside.operators import anomaly, audit, blend, context, select
from quayside.plans import direct, evaluate, models
from quayside.sources import sinks
from quayside.sources.shared import written

_Q: dict = {}
_SQL: dict[str, str] = {}
_ENDS = decisions._ENDS


def _add(name: str, query, sql: str | None) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    if sql:
        _SQL[name] = sql


# daily evidence ---------------------------------------------------------------------------------------------------


def _daily(s, d):
    return audit.daily_scores(anomaly.scores(base._state(s, d)), _ENDS)


_DAILY = f"""{_SCORED}, day0 AS (SELECT date_key, quantile_cont(score, 0.9) AS score, bool_or(known_event) AS any_event FROM scored GROUP BY date_key),
day AS (SELECT *, CASE WHEN date_key <= DATE '{_ENDS[0]}' THEN 'train' WHEN date_key <= DATE '{_ENDS[1]}' THEN 'validation' WHEN date_key <= DATE '{_ENDS[2]}' THEN 'calibration' ELSE 'holdout' END AS split FROM day0)"""
_add("anm8_10_win20_holdout_state", lambda s, d: audit.holdout_state(_daily(s, d)), f"""{_DAILY}, st AS (SELECT quantile_cont(score, 0.98) AS t, greatest((quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, 1e-6) AS sc FROM day WHERE split = 'calibration'),
h AS (SELECT day.*, coalesce(score > t, false) AS f, exp(-greatest((score - t) / sc, 0.0)) AS down FROM day, st),
w AS (SELECT *, coalesce(CASE WHEN any_event THEN greatest(down, 0.65) ELSE down END, 1.0) AS wt, avg(score) OVER (ORDER BY date_key ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(score) OVER (ORDER BY date_key ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS m28, avg(CAST(f AS INT)) OVER (ORDER BY date_key ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS r28 FROM h)
SELECT date_key, {_r('score', 'score')}, any_event, split, CASE WHEN split = 'holdout' THEN f END AS flag, {', '.join(_r(f"CASE WHEN split = 'holdout' THEN {a} END", b) for a, b in (('wt', 'weight'), ('m7', 'mean_7'), ('m28', 'mean_28'), ('r28', 'flag_rate_28')))} FROM w""")
_HARD = "hd AS (SELECT date_key, sum(abs(qty_available - coalesce(b4321, med7, mean7, l1, 0.0))) AS e, sum(abs(qty_available)) AS v FROM based GROUP BY date_key), hard AS (SELECT date_key, sum(e) OVER nx / nullif(sum(v) OVER nx, 0) AS difficulty FROM hd WINDOW nx AS (ORDER BY date_key ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))"
_add("anm11_future_difficulty", lambda s, d: audit.difficulty(base._state(s, d)), f"{_LAGGED}, {_HARD} SELECT date_key, {_r('difficulty', 'difficulty')} FROM hard")
_add("anm12_win26_diagnostics", lambda s, d: audit.diagnostics(_daily(s, d).where("split = 'holdout'"), audit.difficulty(base._state(s, d))), f"""{_DAILY}, {_HARD}, j AS (SELECT date_key, round(score, 9) AS score, round(difficulty, 9) AS difficulty, any_event FROM day JOIN hard USING (date_key) WHERE split = 'holdout' AND score IS NOT NULL AND difficulty IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs, rank() OVER (ORDER BY difficulty) + (count(*) OVER (PARTITION BY difficulty) - 1) / 2 AS rd, lag(score) OVER (ORDER BY date_key) AS before FROM j), t AS (SELECT quantile_cont(score, 0.9) AS top FROM j)
SELECT count(*) AS n, {_r('corr(rs, rd)', 'rank_correlation')}, {_r('corr(score, before)', 'autocorrelation')}, {_r('avg(difficulty) FILTER (WHERE score >= top) / avg(difficulty)', 'top_lift')}, {_r('avg(CAST(any_event AS INT))', 'event_share')} FROM r, t""")
_add("anm14_integrity", lambda s, d: audit.integrity(_daily(s, d)), f"{_DAILY}, c AS (SELECT *, list_position(['train', 'validation', 'calibration', 'holdout'], split) AS place FROM day), l AS (SELECT *, lag(date_key) OVER (ORDER BY date_key) AS pd, lag(place) OVER (ORDER BY date_key) AS pp FROM c) SELECT count(*) AS n_days, count(*) FILTER (WHERE date_key IS NULL) AS null_dates, count(*) FILTER (WHERE date_key = pd) AS repeated_dates, count(*) FILTER (WHERE score < 0 OR isinf(score) OR isnan(score)) AS bad_scores, count(*) FILTER (WHERE place < pp) AS splits_back FROM l")
_RISK = ["price", "discount_web", "discount_app"]


def _risk(s, d):
    rows = base._filled(s, d)
    out = audit.context_rarity(rows, _RISK, context.robust_scale(rows, _RISK)).withColumn("rarity", F.round("rarity", 9))
    return audit.risk_rollup(out.withColumn("risk", context.empirical_rank("product_id", "rarity")))


_add("agg19_mdl16_context_risk_by_day", _risk, f"{_STATE}, v AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM filled''' for c in _RISK)}), g AS (SELECT feature, quantile_cont(value, 0.5) AS med, coalesce(nullif((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349, 0), nullif(stddev_pop(value), 0), 1.0) AS sc FROM v GROUP BY feature), r AS (SELECT product_id, date_key, round((" + " + ".join(f"coalesce(abs({c} - (SELECT med FROM g WHERE feature = '{c}')) / (SELECT sc FROM g WHERE feature = '{c}'), 0.0)" for c in _RISK) + f") / 3, 9) AS rarity FROM filled), k AS (SELECT *, cume_dist() OVER (PARTITION BY product_id ORDER BY rarity) AS risk FROM r) SELECT date_key, {_r('avg(risk)', 'mean_risk')}, {_r('max(risk)', 'max_risk')}, count(*) FILTER (WHERE risk >= 0.99) AS flagged FROM k GROUP BY date_key")


_SWEPT = [(n, f) for n in ("downweight", "negative_only", "hard_example", "signed") for f in (0.2, 0.5)]


def _sweep(s, d):
    p = anomaly.profile(base._state(s, d))
    kept = {"systemic": F.col("systemic_flag"), "available": F.col("is_available") == 1}
    made = {f"{n}_{f}": anomaly.weights(F.col("score"), F.col("threshold"), F.col("residual"), F.col("known_event"), n, floor=f, **kept) for n, f in _SWEPT}
    return select.policy_sweep(p, made, "qty_available", "expected")


def _policy(n: str, f: float) -> str:
    down = f"greatest(exp(-coalesce(greatest(score - threshold, 0.0) / threshold, 0.0)), {f})"
    signed = f"CASE WHEN residual < 0 THEN {down} WHEN residual > 0 THEN up ELSE 1.0 END"
    by = {"downweight": down, "negative_only": f"CASE WHEN residual < 0 THEN {down} ELSE 1.0 END", "hard_example": "up", "signed": signed}[n]
    return f"SELECT '{n}_{f}' AS policy, qty_available AS a, expected AS b, {base._weight_sql(by)} AS w FROM profile"


_add("sel11_policy_sweep", _sweep, f"{_SCORED}, x AS ({' UNION ALL '.join(_policy(n, f) for n, f in _SWEPT)}) SELECT policy, count(*) AS n, {_r('avg(w)', 'mean_weight')}, count(*) FILTER (WHERE w < 1) AS weighted_down, {_r('sum(w * abs(a - b)) / nullif(sum(w * abs(a)) FILTER (WHERE b IS NOT NULL), 0)', 'wape')} FROM x GROUP BY policy")

# choices ----------------------------------------------------------------------------------------------------------


def _strategies(s, d):
    flat = base._long(s, d).withColumn("strategy", F.lit("direct"))
    again = decisions._paired(s, d).select("product_id", "origin", "horizon", "target_date", "available", "actual", F.lit("moving_avg").alias("model"), "pred", (F.coalesce("available", F.lit(False)) & F.col("actual").isNotNull()).alias("common"), F.lit("recursive").alias("strategy"))
    return select.primary(evaluate.summary(flat.unionByName(again), ["strategy"]))


_STRAT = f"{decisions._REC}, both_ AS (SELECT 'direct' AS strategy, model, actual, pred FROM long WHERE common UNION ALL SELECT 'recursive', 'moving_avg', actual, pred FROM paired WHERE available AND actual IS NOT NULL), sm AS (SELECT strategy, model, count(*) AS n, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape FROM both_ GROUP BY 1, 2)"
_add("sel1_primary_slice", lambda s, d: _strategies(s, d).select("strategy", "model", "n", "wape"), f"{_STRAT} SELECT strategy, model, n, {_r('wape', 'wape')} FROM sm")
_add("sel2_3_best_strategy", lambda s, d: select.best_strategy(_strategies(s, d)), f"{_STRAT}, b AS (SELECT model, arg_min(strategy, (round(wape, 9), strategy)) AS strategy, min(wape) AS wape FROM sm GROUP BY model) SELECT model, strategy, {_r('wape', 'wape')}, row_number() OVER (ORDER BY round(b.wape, 9), model) AS rank FROM b")


def _families(s, d):
    w = [F.col(f"w_{m}") for m in MODELS]
    family = F.coalesce(*[F.when(c == F.greatest(*w), F.lit(m)) for c, m in zip(w, MODELS)])
    return blend.fit(base._oof(s, d), MODELS).withColumn("family", family)


_FAM = base._FIT + ", fam AS (SELECT *, CASE " + " ".join(f"WHEN w_{m} = greatest({', '.join(f'w_{x}' for x in MODELS)}) THEN '{m}'" for m in MODELS) + " END AS family FROM f)"
_add("sel8_family_top", lambda s, d: select.family_top(_families(s, d), 5, F.col("candidate") == "10-0-0").select("candidate", "family", "aligned", "rank"), f"{_FAM}, rk AS (SELECT *, row_number() OVER (ORDER BY round(aligned, 12), candidate) AS rank, row_number() OVER (PARTITION BY family ORDER BY round(aligned, 12), candidate) AS inf FROM fam) SELECT candidate, family, {_r('rk.aligned', 'aligned')}, rank FROM rk WHERE candidate = '10-0-0' OR rank <= 5 OR inf = 1")
_add("agg29_family_rollup", lambda s, d: _families(s, d).groupBy("family").agg(F.count("*").alias("n"), F.avg("aligned").alias("mean_aligned"), F.avg("broad").alias("mean_broad"), F.min("aligned").alias("best_aligned")), f"{_FAM} SELECT family, count(*) AS n, {_r('avg(aligned)', 'mean_aligned')}, {_r('avg(broad)', 'mean_broad')}, {_r('min(aligned)', 'best_aligned')} FROM fam GROUP BY family")


def _cheapest(s, d):
    active = F.size(F.filter(F.array(*[F.col(f"w_{m}") for m in MODELS]), lambda w: w > 0)).alias("cost")
    return select.cheapest_within(_families(s, d).select("candidate", "broad", active), "broad", "cost")


_add("sel15_cheapest_within", _cheapest, f"{_FAM}, ch AS (SELECT candidate, broad, {' + '.join(f'CAST(w_{m} > 0 AS BIGINT)' for m in MODELS)} AS cost FROM fam) SELECT candidate, {_r('ch.broad', 'broad')}, cost FROM ch WHERE ch.broad <= 1.02 * (SELECT min(broad) FROM ch) ORDER BY cost, round(ch.broad, 12), candidate LIMIT 1")


def _long_plan(s, d):
    return decisions._plan(s, d).unpivot(["stratum"], [F.col(f"w_{m}").alias(m) for m in MODELS], "member", "weight").withColumnRenamed("stratum", "scope")


#: The plan with its weights as they are, not rounded.
_PLAN = re.sub(r"round\((k \* .*?), 6\) \+ 0\.0", r"(\1)", decisions._SQL["ens9_shrunk_stratum_plan"])
_LONG_PLAN = " UNION ALL ".join(f"SELECT stratum AS scope, '{m}' AS member, w_{m} AS weight FROM plan" for m in MODELS)
_add("ens16_plan_check", lambda s, d: select.check_plan(_long_plan(s, d), MODELS), f"WITH plan AS ({_PLAN}), lp AS ({_LONG_PLAN}), g AS (SELECT scope, sum(weight) AS total, min(weight) AS least, count(*) FILTER (WHERE weight > 1e-8) AS active, count(*) FILTER (WHERE member NOT IN ({', '.join(repr(m) for m in MODELS)})) AS unknown FROM lp GROUP BY scope) SELECT scope, {_r('total', 'total')}, {_r('least', 'least')}, active, unknown, coalesce(abs(total - 1) < 1e-6 AND least >= 0 AND unknown = 0, false) AS valid FROM g")


def _final(s, d):
    rows = base._oof(s, d).withColumn("stratum", scalar.stratum(F.col("origin")))
    blended = F.greatest(sum((F.col(f"pred_{m}") * F.col(f"w_{m}") for m in MODELS[1:]), F.col(f"pred_{MODELS[0]}") * F.col(f"w_{MODELS[0]}")), F.lit(0.0))
    out = rows.join(F.broadcast(decisions._plan(s, d)), "stratum")  # a row per stratum
    return out.select("product_id", "origin", "horizon", F.round(blended, 6).alias("blend")).withColumn("quantity", scalar.submission(F.col("blend")))


_add("ens12_17_final_blend", _final, f"WITH plan AS ({_PLAN}), o AS ({_OOF} SELECT *, {base._STRATUM} AS stratum FROM oof), b AS (SELECT product_id, origin, horizon, round(greatest({' + '.join(f'pred_{m} * w_{m}' for m in MODELS)}, 0.0), 6) AS blend FROM o JOIN plan USING (stratum)) SELECT product_id, origin, horizon, {_r('b.blend', 'blend')}, CAST(round_even(greatest(b.blend, 0), 0) AS BIGINT) AS quantity FROM b")
_add("srt5_even_origins", lambda s, d: select.even_origins(base._panel(s, d), 12), f"{base._PANEL}, n AS (SELECT date_key, row_number() OVER (ORDER BY date_key) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date_key FROM panel)) SELECT date_key FROM n WHERE n <= 12 OR list_contains([CAST(floor((i * (n - 1) + 5.5) / 11) AS BIGINT) FOR i IN range(0, 12)], pos)")
_add("srt6_recent_origins", lambda s, d: select.recent_origins(base._panel(s, d), 4), f"{base._PANEL}, m AS (SELECT max(date_key) AS last FROM panel) SELECT CAST(last - CAST(7 * i AS INT) AS DATE) AS origin FROM m, range(1, 5) r(i)")

# models: SQL cannot express the fits ------------------------------------------------------------------------------


def _modelled(kind: str, trees: int = 20, seeds: tuple[int, ...] = (42,)):
    def query(s, d):
        panel = written(direct.direct_panel(base._state(s, d)))
        train = direct.recency_weights(direct.trainable(panel, "2000-12-03"), "2000-12-03", 365)
        held = panel.where(F.col("origin").isin([F.lit(o).cast("date") for o in ("2000-12-03", "2001-10-21")]))
        out = models.fit_predict(train, held, kind, trees, seeds).withColumnRenamed("target", "actual")
        return out.where(F.coalesce("available", F.lit(False))).groupBy("horizon").agg(*evaluate.metrics())

    return query


_add("mdl1_8_ridge", _modelled("ridge"), None)
_add("mdl2_trees_of_20", _modelled("trees_a"), None)
_add("mdl4_tweedie", _modelled("tweedie"), None)
_add("mdl6_huber", _modelled("huber"), None)

# report tables ----------------------------------------------------------------------------------------------------

_add("snk2_forecast_table", lambda s, d: sinks.forecast_table(base._oof(s, d), ["product_id", "origin", "horizon"], MODELS), f"{_OOF} SELECT product_id, origin, horizon, model, {_r('pred', 'raw')}, CAST(CASE WHEN pred IS NOT NULL THEN round_even(greatest(pred, 0), 0) END AS BIGINT) AS quantity FROM long")
_add("snk5_win23_history_payload", lambda s, d: sinks.payload(base._state(s, d)).select("product_id", F.size("history").cast("long").alias("n"), F.sha2(F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["date_key"].cast("string"), F.coalesce(F.floor(h["quantity"]).cast("string"), F.lit("~")))), ","), 256).alias("digest")), f"{_STATE}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date_key DESC) AS rn FROM state) SELECT product_id, count(*) AS n, sha256(string_agg(CAST(date_key AS VARCHAR) || ':' || coalesce(CAST(CAST(floor(quantity) AS BIGINT) AS VARCHAR), '~'), ',' ORDER BY date_key)) AS digest FROM r WHERE rn <= 90 GROUP BY product_id")
_MARK = ["product_id", "date_key", "is_promo"]
_add("snk8_source_boundary", lambda s, d: sinks.boundary(base._panel(s, d), "2000-12-03", _MARK), f"{base._PANEL}, b AS (SELECT * FROM panel WHERE date_key < DATE '2000-12-03') SELECT (SELECT min(date_key) FROM panel) AS first, max(date_key) AS last, (SELECT count(*) FROM panel WHERE date_key >= DATE '2000-12-03') AS left_out, count(*) AS n_rows, CAST(sum(CAST(product_id IS NULL AS INT) + CAST(date_key IS NULL AS INT) + CAST(is_promo IS NULL AS INT)) AS BIGINT) AS n_nulls, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|', product_id, CAST(date_key AS VARCHAR), CAST(is_promo AS VARCHAR))), 1, 8)) AS BIGINT)) AS VARCHAR) AS digest FROM b")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
