"""Registered queries of product reports, errors in their context, splits, prepared windows and walk-forward runs with the
anomaly layer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quayside import catalog as base
from quayside import catalog_reports as reports
from quayside.catalog import _METRICS, _OOF, _PANEL, _SCORED, _STATE, MODELS, ORIGINS, _r
from quayside.operators import anomaly, report, windows
from quayside.plans import direct, evaluate, walk
from quayside.sources import panel as source
from quayside.sources.shared import shared_dir, written

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    _Q[name] = lambda s, d: base.rounded(query(s, d))
    if sql:
        _SQL[name] = sql


# a product's anomaly report -------------------------------------------------------------------------------------------

_FUTURE = ("2001-10-22", "2001-11-18")


def _reports(s, d):
    """Timelines and lists as digests and texts, so that they can be compared."""
    state = base._state(s, d)
    profile = anomaly.profile(state).withColumn("score", F.round("score", 9))
    future = base._panel(s, d).where(F.col("date_key").between(*[F.lit(x).cast("date") for x in _FUTURE])).select("product_id", "date_key", "is_promo", "campaign_web")
    made = report.product_reports(profile, future)
    text = lambda a, f, by: F.array_join(F.transform(a, f), by)
    day = lambda x: x["date_key"].cast("string")
    bit = lambda x: x.cast("int").cast("string")
    marks = lambda x: F.concat(day(x), F.lit(":"), bit(x["flag"]), bit(x["known_event"]), bit(x["systemic_flag"]))
    ahead = lambda x: F.concat(day(x), F.lit(":"), bit(x["is_promo"]), F.lit(":"), x["campaign_web"].cast("string"))
    return made.select(
        "product_id", "observed_days", "exceedances", "on_events", "max_score", "mean_weight", F.size("timeline").alias("n_timeline"), F.sha2(text("timeline", marks, ","), 256).alias("timeline_sha256"),
        text("top", day, ",").alias("top_days"), text("future", ahead, ",").alias("future"),
    )


_add(
    "agg30_product_report",
    _reports,
    f"""{_SCORED}, p AS (
  SELECT *, round(score, 9) AS sc, CAST(coalesce(flag, false) AS INT) AS f, CAST(coalesce(known_event, false) AS INT) AS e, CAST(coalesce(systemic_flag, false) AS INT) AS y FROM profile),
own AS (
  SELECT product_id, count(quantity) AS observed_days, CAST(sum(f) AS BIGINT) AS exceedances, CAST(sum(f * e) AS BIGINT) AS on_events, {_r('max(sc)', 'max_score')}, {_r('avg(weight)', 'mean_weight')},
         count(*) AS n_timeline, sha256(string_agg(CAST(date_key AS VARCHAR) || ':' || f || e || y, ',' ORDER BY date_key)) AS timeline_sha256 FROM p GROUP BY product_id),
ranked AS (SELECT product_id, date_key, row_number() OVER (PARTITION BY product_id ORDER BY sc DESC, date_key) AS k FROM p WHERE f = 1),
top AS (SELECT product_id, string_agg(CAST(date_key AS VARCHAR), ',' ORDER BY k) AS days FROM ranked WHERE k <= 20 GROUP BY product_id),
ahead AS (
  SELECT product_id, string_agg(CAST(date_key AS VARCHAR) || ':' || CAST(is_promo AS INT) || ':' || campaign_web, ',' ORDER BY date_key) AS future
  FROM panel WHERE date_key BETWEEN DATE '{_FUTURE[0]}' AND DATE '{_FUTURE[1]}' GROUP BY product_id)
SELECT own.*, coalesce(days, '') AS top_days, coalesce(future, '') AS future FROM own LEFT JOIN top USING (product_id) LEFT JOIN ahead USING (product_id)""",
)

# an error's context ----------------------------------------------------------------------------------------------------


def _error_context(s, d):
    state = written(base._state(s, d))
    worst = report.largest_errors(base._oof(s, d), "pred_baseline", 20)
    made = report.error_context(worst.select("product_id", "origin", "horizon", "actual", "error", "rank"), state)
    return made.select("product_id", "origin", "horizon", "rank", "actual", "error", "product_lift", "portfolio_lift", "actual_percentile")


def _lift_sql(value: str) -> str:
    mean = "avg(CASE WHEN origin - date_key BETWEEN {} AND {} THEN %s END)" % value
    return f"{mean.format(0, 6)} / nullif({mean.format(7, 13)}, 0) - 1"


_add(
    "agg27_top_error_context",
    _error_context,
    f"""{_OOF}, ranked AS (
  SELECT product_id, origin, horizon, actual, pred_baseline - actual AS error,
         row_number() OVER (PARTITION BY origin ORDER BY round(abs(pred_baseline - actual), 6) DESC, product_id, horizon) AS rank
  FROM oof WHERE available AND actual IS NOT NULL AND pred_baseline IS NOT NULL),
worst AS (SELECT * FROM ranked WHERE rank <= 20),
known AS (SELECT product_id, date_key, quantity FROM state WHERE quantity IS NOT NULL),
own AS (SELECT product_id, origin, {_lift_sql('quantity')} AS lift FROM known JOIN (SELECT DISTINCT product_id, origin FROM worst) USING (product_id) WHERE origin - date_key BETWEEN 0 AND 13 GROUP BY 1, 2),
daily_total AS (SELECT date_key, sum(quantity) AS total FROM known GROUP BY 1),
market AS (SELECT origin, {_lift_sql('total')} AS lift FROM daily_total, (SELECT DISTINCT origin FROM worst) WHERE origin - date_key BETWEEN 0 AND 13 GROUP BY 1),
pct AS (SELECT product_id, origin, horizon, avg(CAST(quantity <= actual AS INT)) AS share FROM worst JOIN known USING (product_id) WHERE date_key <= origin GROUP BY 1, 2, 3)
SELECT w.product_id, w.origin, w.horizon, rank, {_r('actual', 'actual')}, {_r('error', 'error')}, {_r('own.lift', 'product_lift')}, {_r('market.lift', 'portfolio_lift')}, {_r('share', 'actual_percentile')}
FROM worst w LEFT JOIN own ON own.product_id = w.product_id AND own.origin = w.origin LEFT JOIN market ON market.origin = w.origin
LEFT JOIN pct ON pct.product_id = w.product_id AND pct.origin = w.origin AND pct.horizon = w.horizon""",
)

# splits and prepared windows ----------------------------------------------------------------------------------------------

_SHORT = "1995-06-30"


def _splits(s, d):
    """All days by dates; the days up to 1995-06-30 are too few for that and go by shares."""
    days = written(base._state(s, d).select("date_key").distinct())
    by_dates = report.temporal_split(days).withColumn("kind", F.lit("dates"))
    by_shares = report.temporal_split(days.where(F.col("date_key") <= F.lit(_SHORT).cast("date")), least=40).withColumn("kind", F.lit("shares"))
    return by_dates.unionByName(by_shares).groupBy("kind", "split").agg(F.count("*").alias("n"), F.min("date_key").alias("first"), F.max("date_key").alias("last"))


_VALIDATES = "least(greatest(12, round_even(pool * 0.15, 0)), greatest(1, pool // 3))"
_add(
    "anm7_temporal_split",
    _splits,
    f"""{_STATE}, days AS (SELECT DISTINCT date_key FROM state), ends AS (SELECT max(date_key) AS last FROM days),
aged AS (SELECT date_key, CAST(last - date_key AS BIGINT) AS age FROM days, ends),
long AS (SELECT *, count(*) FILTER (WHERE age BETWEEN 360 AND 1454) OVER () AS pool, row_number() OVER (PARTITION BY age BETWEEN 360 AND 1454 ORDER BY date_key) AS k FROM aged),
a AS (SELECT 'dates' AS kind, date_key, CASE WHEN age < 180 THEN 'holdout' WHEN age < 360 THEN 'calibration' WHEN age > 1454 THEN 'ignored' WHEN k > pool - {_VALIDATES} THEN 'validation' ELSE 'train' END AS split FROM long),
few AS (SELECT date_key, row_number() OVER (ORDER BY date_key) AS k, count(*) OVER () AS n FROM days WHERE date_key <= DATE '{_SHORT}'),
sized AS (SELECT *, least(greatest(40, CAST(floor(n * 0.65) AS BIGINT)), n - 40) AS pool FROM few),
b AS (SELECT 'shares' AS kind, date_key, CASE WHEN k <= pool - {_VALIDATES} THEN 'train' WHEN k <= pool THEN 'validation' WHEN k <= least(greatest(pool + 20, CAST(floor(n * 0.85) AS BIGINT)), n - 20) THEN 'calibration' ELSE 'holdout' END AS split FROM sized)
SELECT kind, split, count(*) AS n, min(date_key) AS first, max(date_key) AS last FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
)
_TRAIN_END = "1998-12-31"


def _prepared_windows(s, d):
    """Sums by place of every prepared window, and its last day."""
    made = report.prepared_windows(reports._market_windows(s, d), _TRAIN_END)
    total = lambda i: F.aggregate(F.transform("window", lambda row: row[i]), F.lit(0.0), lambda a, x: a + x)
    last = F.get("window", F.lit(27))
    return made.select("date_key", total(0).alias("demand"), total(1).alias("n_available"), last[0].alias("last_demand"), last[1].alias("last_available"))


_Z = "greatest(-8.0, least(8.0, (coalesce({0}, med_{0}) - mean_{0}) / sd_{0}))"
_add(
    "mdl18_prepared_windows",
    _prepared_windows,
    f"""{_STATE}, m AS (SELECT date_key, CAST(sum(qty_available) AS DOUBLE) AS a, CAST(sum(is_available) AS DOUBLE) AS b, row_number() OVER (ORDER BY date_key) AS rn FROM state GROUP BY date_key),
w AS (SELECT e.date_key AS ends, d.rn = e.rn AS is_last, d.a, d.b FROM m e JOIN m d ON d.rn BETWEEN e.rn - 27 AND e.rn WHERE e.rn >= 28),
t AS (SELECT * FROM w WHERE ends <= DATE '{_TRAIN_END}'),
md AS (SELECT coalesce(median(a), 0.0) AS med_a, coalesce(median(b), 0.0) AS med_b FROM t),
st AS (SELECT any_value(med_a) AS med_a, any_value(med_b) AS med_b, avg(coalesce(a, med_a)) AS mean_a, avg(coalesce(b, med_b)) AS mean_b,
  CASE WHEN stddev_pop(coalesce(a, med_a)) > 1e-6 THEN stddev_pop(coalesce(a, med_a)) ELSE 1.0 END AS sd_a,
  CASE WHEN stddev_pop(coalesce(b, med_b)) > 1e-6 THEN stddev_pop(coalesce(b, med_b)) ELSE 1.0 END AS sd_b FROM t, md),
z AS (SELECT ends, is_last, {_Z.format('a')} AS za, {_Z.format('b')} AS zb FROM w, st)
SELECT ends AS date_key, {_r('sum(za)', 'demand')}, {_r('sum(zb)', 'n_available')}, {_r('max(za) FILTER (WHERE is_last)', 'last_demand')}, {_r('max(zb) FILTER (WHERE is_last)', 'last_available')} FROM z GROUP BY ends""",
)

# a finer grain ----------------------------------------------------------------------------------------------------------

_FINE = ("p_brand", "p_type")
_BY_PART = ("p_partkey",)


def _at_grain(sql: str, grain: tuple[str, ...]) -> str:
    return sql.replace("p_brand AS series", f"concat_ws('|', {', '.join(grain)}) AS series")


def _fine_wape(s, d):
    """Errors of the baselines over thousands of series."""
    state = windows.with_state(source.fill_calendar(source.sales_panel(s, d, _FINE)))
    long = evaluate.long_form(direct.naive_forecasts(state, ORIGINS), MODELS)
    return long.where("common").groupBy("model").agg(*evaluate.metrics())


_add(
    "src1_ids_by_part",
    lambda s, d: source.sales_panel(s, d, _BY_PART).groupBy("product_id").agg(F.count("*").alias("n_days"), F.sum("quantity").alias("quantity"), F.avg("price").alias("price")),
    f"{_at_grain(_PANEL, _BY_PART)} SELECT product_id, count(*) AS n_days, {_r('sum(quantity)', 'quantity')}, {_r('avg(price)', 'price')} FROM panel GROUP BY product_id",
)
_add("pnl11_12_agg6_fine_wape", _fine_wape, f"{_at_grain(_OOF, _FINE)} SELECT model, {_METRICS} FROM long WHERE common GROUP BY model")

# walk-forward with the anomaly layer ----------------------------------------------------------------------------------------


def _layered_walk(s, d):
    """Ridge with and without the layer at one origin, through a store that a broken run would go on from."""
    state = written(base._state(s, d))
    strategies = {"plain": walk.layered_strategy(state, "ridge", mode="off"), "layered": walk.layered_strategy(state, "ridge")}
    wanted = s.createDataFrame([(k, "validation", base.ORIGINS[-2]) for k in strategies], "strategy string, origin_type string, origin string").withColumn("origin", F.col("origin").cast("date"))
    return walk.walk_stored(wanted, strategies, f"{shared_dir(s)}/walk-{uuid.uuid4().hex}")


_add("pnl5_layered_walk", _layered_walk)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
