"""Registered queries of the panel library, each with the SQL that gives the same rows.

Names begin with the identifiers of the inventory they cover. Measures are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import scalar
from quayside.operators import anomaly, blend, windows
from quayside.plans import direct, evaluate, recursive
from quayside.sources import panel as source
from quayside.sources.shared import written

FLAGSHIP = "pnl11_12_agg6_baseline_wape"
ORIGINS = ["1997-03-16", "1997-11-23", "1998-01-18", "1998-06-14", "1999-02-07", "1999-09-12", "2000-12-03", "2001-10-21"]
MODELS = ["baseline", "seasonal_naive", "moving_avg"]


def _panel(s, d):
    return source.sales_panel(s, d)


def _filled(s, d):
    """The gap-filled calendar of the daily panel, which is written: lineitem is read once, however often the rows are."""
    return source.fill_calendar(written(_panel(s, d)))


def _state(s, d):
    return windows.with_state(_filled(s, d))


def _oof(s, d):
    return direct.naive_forecasts(_state(s, d), ORIGINS)


def _long(s, d):
    return evaluate.long_form(_oof(s, d), MODELS)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (no negative zero), counts to long."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out[name] = F.round(F.col(name).cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            out[name] = F.col(name).cast("long")
    return df.withColumns(out)


# SQL pieces -----------------------------------------------------------------------------------------------------

_PANEL = """
WITH line AS (
  SELECT p_brand AS series, CAST(l_shipdate AS DATE) AS date_key, l_orderkey, l_quantity, l_returnflag, l_linestatus,
         l_discount, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey),
daily AS (
  SELECT series, date_key, NOT bool_and(l_returnflag = 'R') AS available,
         coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0.0) AS quantity_app,
         coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0.0) AS quantity_web,
         round(avg(l_discount), 6) AS disc, min(l_orderkey) % 40 AS cw, max(l_orderkey) % 40 AS ca,
         round(avg(p_retailprice), 6) AS price FROM line GROUP BY series, date_key),
ids AS (SELECT series, dense_rank() OVER (ORDER BY series) AS product_id FROM (SELECT DISTINCT p_brand AS series FROM part)),
panel AS (
  SELECT CAST(product_id AS BIGINT) AS product_id, date_key, available, quantity_app, quantity_web,
         quantity_app + quantity_web AS quantity, disc >= 0.08 AS is_promo,
         CASE WHEN cw < 9 THEN [0,1,2,3,4,5,16,18,19][cw + 1] ELSE -1 END AS campaign_web,
         CASE WHEN ca < 9 THEN [0,1,2,3,4,5,16,18,19][ca + 1] ELSE -1 END AS campaign_app,
         CASE WHEN disc >= 0.09 THEN 100 * disc ELSE 0.0 END AS discount_web,
         CASE WHEN quantity_app > 0 AND disc >= 0.09 THEN 100 * disc ELSE 0.0 END AS discount_app, price
  FROM daily JOIN ids USING (series))"""
_COV = ["is_promo", "campaign_web", "campaign_app", "discount_web", "discount_app", "price"]
_FILLED = (
    _PANEL
    + """,
spine AS (SELECT product_id, CAST(unnest(generate_series(min(date_key), max(date_key), INTERVAL 1 DAY)) AS DATE) AS date_key
          FROM panel GROUP BY product_id),
filled AS (
  SELECT s.product_id, s.date_key, p.available, p.quantity_app, p.quantity_web, p.quantity, p.product_id IS NULL AS is_gap, """
    + ", ".join(f"coalesce(last_value(p.{c} IGNORE NULLS) OVER back, last_value(p.{c} IGNORE NULLS) OVER ahead) AS {c}" for c in _COV)
    + """
  FROM spine s LEFT JOIN panel p ON s.product_id = p.product_id AND s.date_key = p.date_key
  WINDOW back AS (PARTITION BY s.product_id ORDER BY s.date_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY s.product_id ORDER BY s.date_key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
)
_STATE = (
    _FILLED
    + """,
state AS (
  SELECT *, CAST(NOT is_gap AS INT) AS observed, CAST(NOT is_gap AND coalesce(available, false) AS INT) AS is_available,
         CAST(NOT is_gap AND NOT coalesce(available, true) AS INT) AS is_unavailable,
         CASE WHEN NOT is_gap AND available THEN quantity END AS qty_available FROM filled)"""
)
_W = "PARTITION BY product_id ORDER BY date_key"


def _past(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _incl(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(d: int, c: str = "qty_available") -> str:
    return f"lag({c}, {d}) OVER ({_W})"


def _weighted(weights) -> str:
    pairs = [(f"l{7 * (k + 1)}", w) for k, w in enumerate(weights) if w]
    num = " + ".join(f"coalesce({v} * {w}, 0.0)" for v, w in pairs)
    den = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {w}.0 ELSE 0.0 END" for v, w in pairs)
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END)"


_LAGGED = (
    _STATE
    + f""",
lagged AS (SELECT *, {", ".join(f"{_lag(d)} AS l{d}" for d in (1, 2, 6, 7, 14, 21, 28, 364, 365, 371))},
  median(qty_available) OVER {_past(7)} AS med7, avg(qty_available) OVER {_past(7)} AS mean7,
  median(qty_available) OVER {_past(28)} AS med28, count(qty_available) OVER {_past(28)} AS n28,
  avg(qty_available) OVER {_incl(28)} AS inc28,
  coalesce(median(qty_available) OVER {_incl(7)}, avg(qty_available) OVER {_incl(7)}, qty_available, 0.0) AS at_origin FROM state),
based AS (SELECT *, {_weighted((4, 3, 2, 1))} AS b4321, {_weighted((8, 4, 2, 1))} AS b8421 FROM lagged)"""
)
_STRATUM = """CASE WHEN len(list_filter(range(1, 8), lambda k: month(CAST(origin + CAST(k AS INT) AS DATE)) > 2)) = 0 THEN 'winter'
  WHEN len(list_filter(range(1, 8), lambda k: month(CAST(origin + CAST(k AS INT) AS DATE)) = 12 OR (month(CAST(origin + CAST(k AS INT) AS DATE)) = 11 AND day(CAST(origin + CAST(k AS INT) AS DATE)) >= 20))) > 0 THEN 'holiday'
  ELSE 'regular' END"""
_DATES = ", ".join(f"DATE '{o}'" for o in ORIGINS)
#: Rows of `based` beside the origins up to a week before them: target columns t_, origin columns o_.
_AHEAD = f"""ahead AS (SELECT b.*, CAST(h AS BIGINT) AS horizon, CAST(b.date_key - CAST(h AS INT) AS DATE) AS origin FROM based b, range(1, 8) r(h))"""
_OOF = (
    _LAGGED
    + f""",
{_AHEAD},
oof AS (
  SELECT o.product_id, o.date_key AS origin, t.horizon, t.date_key AS target_date, t.available, t.quantity AS actual,
         coalesce(t.b4321, o.at_origin) AS pred_baseline, coalesce(t.l7, t.b4321) AS pred_seasonal_naive, o.inc28 AS pred_moving_avg
  FROM based o JOIN ahead t ON o.product_id = t.product_id AND o.date_key = t.origin
  WHERE o.date_key IN ({_DATES}) AND t.origin IN ({_DATES})),
long AS (
  SELECT product_id, origin, horizon, target_date, available, actual, model, pred,
         coalesce(available, false) AND actual IS NOT NULL AND every_ AS common
  FROM (SELECT *, pred_baseline IS NOT NULL AND pred_seasonal_naive IS NOT NULL AND pred_moving_avg IS NOT NULL AS every_ FROM oof)
  UNPIVOT INCLUDE NULLS (pred FOR model IN (pred_baseline AS 'baseline', pred_seasonal_naive AS 'seasonal_naive', pred_moving_avg AS 'moving_avg')))"""
)


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


_OK = "FILTER (WHERE actual IS NOT NULL AND pred IS NOT NULL)"
_METRICS = ", ".join([
    f"count(actual) {_OK} AS n", _r(f"avg(abs(pred - actual)) {_OK}", "mae"), _r(f"sqrt(avg((pred - actual) * (pred - actual)) {_OK})", "rmse"),
    _r(f"100 * (avg(abs(pred - actual) / greatest(actual, 1.0)) {_OK})", "mape"),
    _r(f"CASE WHEN sum(abs(actual)) {_OK} > 0 THEN sum(abs(pred - actual)) {_OK} / sum(abs(actual)) {_OK} END", "wape"),
    _r(f"avg(2 * abs(pred - actual) / (abs(actual) + abs(pred) + 1e-8)) {_OK}", "smape"),
    _r(f"sqrt(avg(pow(ln(1 + greatest(pred, 0.0)) - ln(1 + greatest(actual, 0.0)), 2)) {_OK})", "rmsle"),
    _r(f"avg(pred - actual) {_OK}", "bias"),
    _r(f"CASE WHEN sum(abs(actual)) {_OK} > 0 THEN sum(pred - actual) {_OK} / sum(abs(actual)) {_OK} END", "bias_ratio"),
])

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    _Q[name] = lambda s, d: rounded(query(s, d))
    if sql:
        _SQL[name] = sql


# sources and calendar ---------------------------------------------------------------------------------------------

_ALL = "product_id, date_key, available, round(quantity_app, 6) AS quantity_app, round(quantity_web, 6) AS quantity_web, round(quantity, 6) AS quantity, is_promo, CAST(campaign_web AS BIGINT) AS campaign_web, CAST(campaign_app AS BIGINT) AS campaign_app, round(discount_web, 6) AS discount_web, round(discount_app, 6) AS discount_app, round(price, 6) AS price"
_add("src1_sales_panel", _panel, f"{_PANEL} SELECT {_ALL} FROM panel")
_add("src1_contiguous_ids", lambda s, d: source.contiguous_ids(_panel(s, d)), f"{_PANEL} SELECT count(DISTINCT product_id) AS n_ids, min(product_id) AS lowest, max(product_id) AS highest, min(product_id) = 1 AND max(product_id) = count(DISTINCT product_id) AS contiguous FROM panel")
_add("src2_epoch_dates", lambda s, d: source.coerce_epoch(s.read.parquet(f"{d}/events.parquet").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("day")), "day"), "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
_add("src4_future_covariates", lambda s, d: source.sanitize_future(_panel(s, d).where("date_key > date'2001-10-28'")), f"{_PANEL} SELECT product_id, date_key, CAST(campaign_web AS BIGINT) AS campaign_web, CAST(campaign_app AS BIGINT) AS campaign_app, round(discount_web, 6) AS discount_web, round(discount_app, 6) AS discount_app, is_promo, round(price, 6) AS price FROM panel WHERE date_key > DATE '2001-10-28'")
_add("jn1_calendar_fill", _filled, f"{_FILLED} SELECT {_ALL}, is_gap FROM filled")
_add("jn14_duplicate_keys", lambda s, d: source.duplicate_keys(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
_add("agg1_2_reference_dates", lambda s, d: source.reference_dates(_filled(s, d)), f"{_FILLED} SELECT product_id, min(date_key) AS first_seen, coalesce(min(date_key) FILTER (WHERE available AND NOT is_gap), min(date_key)) AS first_available, round(median(price), 6) AS price_ref FROM filled GROUP BY product_id")

# projections ------------------------------------------------------------------------------------------------------


def _calendar(s, d):
    days = _panel(s, d).select("date_key").distinct()
    return days.select("date_key", *[v.alias(k) for k, v in scalar.calendar().items()])


_DAYS = f"{_PANEL}, days AS (SELECT DISTINCT date_key FROM panel)"
_CAL = {"dow": "isodow(date_key) - 1", "dom": "day(date_key)", "month": "month(date_key)", "week": "week(date_key)", "doy": "dayofyear(date_key)"}
_add("prj1_calendar", _calendar, f"{_DAYS} SELECT date_key, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _CAL.items())}, CAST(isodow(date_key) >= 6 AS BIGINT) AS weekend, " + ", ".join(_r(f"{f}(({_CAL[k]}) * 2 * pi() / {p})", f"{k}_{f}") for k, p in (("dow", 7), ("month", 12), ("doy", 365), ("week", 52)) for f in ("sin", "cos")) + " FROM days")


def _nth(y: str, month: int, weekday: int, n: int) -> str:
    first = f"make_date({y}, {month}, 1)"
    return f"({first} + CAST((({weekday} - (isodow({first}) - 1)) % 7 + 7) % 7 + {7 * (n - 1)} AS INT))"


_EV = {"black_friday": lambda y: _nth(y, 11, 4, 4), "mothers_day": lambda y: _nth(y, 5, 6, 2), "christmas": lambda y: f"make_date({y}, 12, 25)", "new_year": lambda y: f"make_date({y}, 1, 1)"}
_GAPS = ", ".join(f"date_key - {e(f'(year(date_key) + {k})')} AS {n}_{i}" for n, e in _EV.items() for i, k in enumerate((-1, 0, 1)))
_NEAR = ", ".join(f"greatest(-60, least(60, CASE WHEN abs({n}_0) <= least(abs({n}_1), abs({n}_2)) THEN {n}_0 WHEN abs({n}_1) <= abs({n}_2) THEN {n}_1 ELSE {n}_2 END)) AS {n}" for n in _EV)
_add("prj2_3_4_events", lambda s, d: _panel(s, d).select("date_key").distinct().select("date_key", *[v.alias(k) for k, v in scalar.events().items()]), f"{_DAYS}, gaps AS (SELECT date_key, {_GAPS} FROM days), near AS (SELECT date_key, {_NEAR} FROM gaps) SELECT date_key, " + ", ".join(f"CAST({n} AS BIGINT) AS {n}_days, {_r(f'exp(-abs({n}) / 14.0)', f'{n}_near')}" for n in _EV) + ", CAST(abs(black_friday) <= 4 AS BIGINT) AS black_friday_window, CAST(abs(christmas) <= 10 AS BIGINT) AS christmas_window, CAST(strftime(date_key, '%m-%d') >= '12-27' OR strftime(date_key, '%m-%d') <= '01-07' AS BIGINT) AS new_year_window FROM near")


def _price_features(s, d):
    rows = _filled(s, d)
    ref = source.reference_dates(rows)
    out = rows.join(F.broadcast(ref), "product_id")
    years = F.datediff("date_key", F.lit("2021-01-01").cast("date")) / 365.25
    return out.select(
        "product_id", "date_key", scalar.campaign_index(F.col("campaign_web")).alias("web_index"), *[v.alias(k) for k, v in {**scalar.prices(), **scalar.campaigns()}.items()], scalar.known_event().alias("known_event"),
        scalar.price_relative(F.col("price"), F.col("price_ref")).alias("price_relative"), F.datediff("date_key", "first_seen").alias("age"), F.datediff("date_key", "first_available").alias("available_age"), (F.col("date_key") < F.col("first_available")).alias("before_available"), years.alias("years"),
    )


_PW, _PA = "price * (1 - discount_web / 100)", "price * (1 - discount_app / 100)"
_WEB, _APP, _DISC = "campaign_web <> -1", "campaign_app <> -1", "greatest(discount_web, discount_app) > 0"
_FLAGS = {"web_active": _WEB, "app_active": _APP, "any_active": f"{_WEB} OR {_APP}", "app_only": f"{_APP} AND NOT ({_WEB})", "same_subtype": f"{_WEB} AND campaign_web = campaign_app", "discount_without_campaign": f"{_DISC} AND NOT ({_WEB} OR {_APP})", "app_discount_higher": "discount_app > discount_web"}
_add("prj5_6_7_8_9_10_12_jn2_price_campaign_lifecycle", _price_features, f"{_FILLED}, ref AS (SELECT product_id, min(date_key) AS first_seen, coalesce(min(date_key) FILTER (WHERE available AND NOT is_gap), min(date_key)) AS first_available, median(price) AS price_ref FROM filled GROUP BY product_id) SELECT product_id, date_key, CAST(coalesce(list_position([-1,0,1,2,3,4,5,16,18,19], campaign_web) - 1, 0) AS BIGINT) AS web_index, {_r('greatest(discount_web, discount_app)', 'discount_max')}, {_r(_PW, 'price_web')}, {_r(_PA, 'price_app')}, {_r(f'ln(1 + greatest({_PW}, 0.0)) - ln(1 + greatest({_PA}, 0.0))', 'app_price_advantage')}, {', '.join(f'CAST(({v}) AS DOUBLE) AS {k}' for k, v in _FLAGS.items())}, is_promo OR {_WEB} OR {_APP} OR discount_web > 0 OR discount_app > 0 AS known_event, {_r('coalesce(price / nullif(price_ref, 0), 1.0)', 'price_relative')}, CAST(date_key - first_seen AS BIGINT) AS age, CAST(date_key - first_available AS BIGINT) AS available_age, date_key < first_available AS before_available, {_r('(date_key - make_date(2021, 1, 1)) / 365.25', 'years')} FROM filled JOIN ref USING (product_id)")
_add("prj11_availability", lambda s, d: _state(s, d).select("product_id", "date_key", "observed", "is_available", "is_unavailable", "qty_available"), f"{_STATE} SELECT product_id, date_key, CAST(observed AS BIGINT) AS observed, CAST(is_available AS BIGINT) AS is_available, CAST(is_unavailable AS BIGINT) AS is_unavailable, round(qty_available, 6) AS qty_available FROM state")
_add("prj17_18_submission_strata", lambda s, d: _oof(s, d).select("product_id", "origin", "horizon", scalar.submission(F.col("pred_moving_avg")).alias("quantity"), scalar.stratum(F.col("origin")).alias("stratum")), f"{_OOF} SELECT product_id, origin, horizon, CAST(CASE WHEN pred_moving_avg IS NOT NULL THEN round_even(greatest(pred_moving_avg, 0), 0) END AS BIGINT) AS quantity, {_STRATUM} AS stratum FROM oof")


def _transforms(s, d):
    share, ok = scalar.app_share(F.col("quantity_app"), F.col("quantity"))
    y, b = F.col("qty_available"), F.lag("qty_available", 7).over(windows.days())
    out = _state(s, d).withColumn("before", b)
    return out.select("product_id", "date_key", (F.log1p(y) - F.log1p("before")).alias("residual"), scalar.safe_log_ratio(y, F.col("before")).alias("safe_ratio"), scalar.safe_expm1(F.log1p(y) * 100, F.col("before"), 1e6).alias("guarded"), share.alias("share"), ok.alias("share_known"))


_add("prj13_14_15_16_23_transforms", _transforms, f"{_STATE}, t AS (SELECT *, {_lag(7)} AS before FROM state) SELECT product_id, date_key, {_r('ln(1 + qty_available) - ln(1 + before)', 'residual')}, {_r('CASE WHEN qty_available >= 0 AND before >= 0 THEN ln(1 + qty_available) - ln(1 + before) END', 'safe_ratio')}, {_r('least(greatest(coalesce(CASE WHEN ln(1 + qty_available) * 100 <= 707.782712893384 THEN exp(ln(1 + qty_available) * 100) - 1 END, before), 0.0), 1000000.0)', 'guarded')}, {_r('CASE WHEN coalesce(quantity_app >= 0 AND quantity > 0 AND quantity_app <= quantity, false) THEN (quantity_app + 1) / (quantity + 2) ELSE 0.5 END', 'share')}, coalesce(quantity_app >= 0 AND quantity > 0 AND quantity_app <= quantity, false) AS share_known FROM t")

# windows ----------------------------------------------------------------------------------------------------------


def _rolling_sql(n: int, inclusive: bool) -> str:
    w = _incl(n) if inclusive else _past(n)
    out = [_r(f"avg(qty_available) OVER {w}", f"mean_{n}"), _r(f"coalesce(stddev_samp(qty_available) OVER {w}, 0.0)", f"std_{n}"), _r(f"median(qty_available) OVER {w}", f"median_{n}")]
    rate = lambda c, name: _r(f"coalesce(sum({c}) OVER {w}, 0) / greatest(1, count(*) OVER {w})", name)
    for name, c in (("is_available", "is_available"), ("observed", "observed"), ("is_unavailable", "is_unavailable"), ("gap", "CAST(is_gap AS INT)")):
        out += [f"CAST(sum({c}) OVER {w} AS BIGINT) AS {name}_{n}", rate(c, f"{name}_rate_{n}")]
    return ", ".join([*out, rate("is_unavailable", f"stockout_rate_{n}")])


_add("win1_rolling_state", lambda s, d: _state(s, d).select("product_id", "date_key", *[v.alias(k) for n in (7, 14, 28) for k, v in windows.rolling_state(n).items()]), f"{_STATE} SELECT product_id, date_key, {', '.join(_rolling_sql(n, False) for n in (7, 14, 28))} FROM state")
_add("win2_inclusive_state", lambda s, d: _state(s, d).select("product_id", "date_key", *[v.alias(k) for n in (7, 14, 28) for k, v in windows.rolling_state(n, True).items()]), f"{_STATE} SELECT product_id, date_key, {', '.join(_rolling_sql(n, True) for n in (7, 14, 28))} FROM state")
_LAGS = [0, 1, 2, 6, 7, 14, 21, 28, 364, 365, 371]
_add("win3_4_lags", lambda s, d: _state(s, d).select("product_id", "date_key", *[v.alias(k) for k, v in windows.lags("qty_available", _LAGS).items()]), f"{_STATE} SELECT product_id, date_key, {', '.join(_r('qty_available' if k == 0 else _lag(k), f'lag_{k}') for k in _LAGS)} FROM state")
_MED = "CASE WHEN len({0}) > 0 THEN ({0}[(len({0}) + 1) // 2] + {0}[len({0}) // 2 + 1]) / 2 END"
_SORTED = "list_sort(list_filter([{}], lambda x: x IS NOT NULL))"
_add("win5_6_jn3_baselines", lambda s, d: _state(s, d).select("product_id", "date_key", *[windows.baseline(v).alias(v) for v in ("w4321", "w8421", "lag7", "median")], windows.baseline_with_fallback().alias("with_fallback")), f"{_LAGGED}, m AS (SELECT *, {_SORTED.format('l7, l14, l21, l28')} AS q FROM based) SELECT product_id, date_key, {_r('b4321', 'w4321')}, {_r('b8421', 'w8421')}, {_r('l7', 'lag7')}, {_r(_MED.format('q'), 'median')}, {_r('coalesce(b4321, med7, mean7, l1, 0.0)', 'with_fallback')} FROM m")
_add("win7_8_9_10_lifecycle", lambda s, d: windows.lifecycle(_state(s, d)).select("product_id", "date_key", "observed_days", "available_days", "returned", "days_since_available", "days_since_observed", "ever_available", "unavailable_streak"), f"""{_STATE}, a AS (SELECT *, last_value(CASE WHEN is_available = 1 THEN date_key END IGNORE NULLS) OVER p AS la, last_value(CASE WHEN observed = 1 THEN date_key END IGNORE NULLS) OVER p AS lo,
  sum(observed) OVER p AS od, sum(is_available) OVER p AS ad, sum(1 - is_unavailable) OVER p AS island, is_available = 1 AND coalesce(lag(is_unavailable) OVER ({_W}), 0) = 1 AS returned
  FROM state WINDOW p AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT product_id, date_key, CAST(od AS BIGINT) AS observed_days, CAST(ad AS BIGINT) AS available_days, returned, CAST(date_key - la AS BIGINT) AS days_since_available, CAST(date_key - lo AS BIGINT) AS days_since_observed, la IS NOT NULL AS ever_available,
  CAST(sum(is_unavailable) OVER (PARTITION BY product_id, island ORDER BY date_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS unavailable_streak FROM a""")


def _channel_sql() -> str:
    out = [_r("share", "share_lag_0"), _r(f"lag(share, 7) OVER ({_W})", "share_lag_7")]
    for n in (7, 28):
        w = _incl(n)
        out += [_r(f"CASE WHEN sum(qty_available) OVER {w} > 0 THEN sum(app) OVER {w} / sum(qty_available) OVER {w} END", f"share_{n}"), _r(f"avg(app) OVER {w}", f"app_mean_{n}"), _r(f"avg(qty_available - app) OVER {w}", f"web_mean_{n}")]
    d = " - ".join(f"(CASE WHEN sum(qty_available) OVER {_incl(n)} > 0 THEN sum(app) OVER {_incl(n)} / sum(qty_available) OVER {_incl(n)} END)" for n in (7, 28))
    return ", ".join([*out, _r(d, "share_delta"), f"count(share) OVER {_incl(28)} AS share_count_28"])


def _channels(s, d):
    rows = _state(s, d).withColumn("__s", F.lit(0))
    c = windows.channel_history()
    return rows.select("product_id", "date_key", *[v.alias(k) for k, v in c.items()])


_add("win11_channel_history", _channels, f"{_STATE}, c AS (SELECT *, CASE WHEN is_available = 1 THEN quantity_app END AS app, CASE WHEN qty_available > 0 THEN (CASE WHEN is_available = 1 THEN quantity_app END) / qty_available END AS share FROM state) SELECT product_id, date_key, {_channel_sql()} FROM c")
_add("win12_price_history", lambda s, d: _filled(s, d).withColumns({k: v for k, v in scalar.prices().items() if k in ("price_web", "price_app")}).select("product_id", "date_key", *[v.alias(k) for k, v in windows.price_history().items()]), f"{_FILLED}, c AS (SELECT *, {_PW} AS price_web, {_PA} AS price_app FROM filled) SELECT product_id, date_key, {_r(_lag(7, 'price'), 'price_lag_7')}, {', '.join(_r(f'median({c}) OVER {_incl(28)}', f'{c}_median_28') for c in ('price', 'price_web', 'price_app'))} FROM c")


def _avg(n: int) -> str:
    return f"avg(qty_available) OVER {_incl(n)}"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} >= 0 AND {b} >= 0 THEN ln(1 + {a}) - ln(1 + {b}) END"


_DAYNO = "(CASE WHEN qty_available IS NOT NULL THEN CAST(date_key - DATE '1970-01-01' AS DOUBLE) END)"
_add("win13_14_trends", lambda s, d: _state(s, d).select("product_id", "date_key", *[v.alias(k) for k, v in windows.trends().items()]), f"{_STATE} SELECT product_id, date_key, {_r(_ratio(_avg(7), _avg(28)), 'trend_7_28')}, {_r(_ratio(_avg(14), _avg(28)), 'trend_14_28')}, {_r(_ratio('qty_available', _avg(28)), 'trend_0_28')}, " + ", ".join(_r(f"CASE WHEN count(qty_available) OVER {_incl(n)} >= 2 THEN regr_slope(ln(1 + qty_available), {_DAYNO}) OVER {_incl(n)} END", f"slope_{n}") for n in (7, 28)) + " FROM state")
_add("win15_annual_reference", lambda s, d: _state(s, d).select("product_id", "date_key", *[v.alias(k) for k, v in windows.annual_reference().items()]), f"{_LAGGED}, m AS (SELECT *, {_SORTED.format('l364, l365, l371')} AS q FROM based), n AS (SELECT *, {_MED.format('q')} AS annual FROM m) SELECT product_id, date_key, {_r('annual', 'annual')}, annual IS NULL AS annual_missing, {_r(_ratio('b4321', 'annual'), 'baseline_annual')} FROM n")
def _weight_sql(by: str) -> str:
    """A policy's weight with the floors of events and systemic days; 1 for unscored or unavailable days."""
    own = f"CASE WHEN score IS NULL THEN 1.0 ELSE {by} END"
    event = f"CASE WHEN known_event AND coalesce(residual > 0, false) THEN greatest({own}, 0.65) ELSE {own} END"
    return f"CASE WHEN is_available = 0 THEN 1.0 WHEN systemic_flag THEN greatest({event}, 0.5) ELSE {event} END"


_SCORED = (
    _LAGGED
    + f""",
expected AS (SELECT *, coalesce(b4321, CASE WHEN n28 >= 4 THEN med28 END, med7) AS expected FROM based),
resid AS (SELECT *, ln(1 + qty_available) - ln(1 + expected) AS residual FROM expected),
quant AS (SELECT *, quantile_cont(residual, [0.25, 0.5, 0.75]) OVER {_past(180)} AS qs, count(residual) OVER {_past(180)} AS nq FROM resid),
scored AS (SELECT *, CASE WHEN nq >= 28 THEN abs(residual - qs[2]) / greatest((qs[3] - qs[1]) / 1.349, 0.10) END AS score,
  is_promo OR campaign_web <> -1 OR campaign_app <> -1 OR discount_web > 0 OR discount_app > 0 AS known_event FROM quant),
thr AS (SELECT quantile_cont(score, 0.99) AS threshold FROM scored),
sys0 AS (SELECT date_key, quantile_cont(score, 0.9) AS systemic_score FROM scored GROUP BY date_key),
sys AS (SELECT date_key, systemic_score, coalesce(systemic_score > (SELECT quantile_cont(systemic_score, 0.98) FROM sys0), false) AS systemic_flag FROM sys0),
sysr AS (SELECT *, avg(CAST(systemic_flag AS INT)) OVER (ORDER BY date_key ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS systemic_rate_28 FROM sys),
fl AS (SELECT s.*, threshold, coalesce(score > threshold, false) AS flag, row_number() OVER ({_W}) AS rn FROM scored s, thr),
prof AS (SELECT f.*, systemic_score, systemic_flag, systemic_rate_28,
  avg(CAST(flag AS INT)) OVER (PARTITION BY product_id ORDER BY f.date_key ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS flag_rate_28,
  rn - last_value(CASE WHEN flag THEN rn END IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY f.date_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_flag,
  greatest(exp(-coalesce(greatest(score - threshold, 0.0) / threshold, 0.0)), 0.2) AS down,
  least(exp(coalesce(greatest(score - threshold, 0.0) / threshold, 0.0)), 2.0) AS up
  FROM fl f JOIN sysr USING (date_key)),
profile AS (SELECT *, """
    + _weight_sql("down")
    + """ AS weight FROM prof)"""
)
_add("win16_17_causal_score", lambda s, d: anomaly.scores(_state(s, d)).select("product_id", "date_key", "expected", "residual", "center", "scale", "score"), f"{_SCORED} SELECT product_id, date_key, {_r('expected', 'expected')}, {_r('residual', 'residual')}, {_r('CASE WHEN nq >= 28 THEN qs[2] END', 'center')}, {_r('CASE WHEN nq >= 28 THEN greatest((qs[3] - qs[1]) / 1.349, 0.10) END', 'scale')}, {_r('score', 'score')} FROM scored")
_add("anm1_4_9_win18_19_agg5_jn6_profile", lambda s, d: anomaly.profile(_state(s, d)).select("product_id", "date_key", "score", "threshold", "flag", "flag_rate_28", "days_since_flag", "systemic_score", "systemic_flag", "systemic_rate_28", "weight"), f"{_SCORED} SELECT product_id, date_key, {_r('score', 'score')}, {_r('threshold', 'threshold')}, flag, {_r('flag_rate_28', 'flag_rate_28')}, CAST(days_since_flag AS BIGINT) AS days_since_flag, {_r('systemic_score', 'systemic_score')}, systemic_flag, {_r('systemic_rate_28', 'systemic_rate_28')}, {_r('weight', 'weight')} FROM profile")
_add("agg20_product_summary", lambda s, d: anomaly.product_summary(anomaly.profile(_state(s, d))), f"{_SCORED} SELECT product_id, count(score) AS scored, CAST(sum(CAST(flag AS INT)) AS BIGINT) AS exceedances, CAST(sum(CAST(flag AND known_event AS INT)) AS BIGINT) AS on_events, {_r('max(score)', 'max_score')}, {_r('avg(weight)', 'mean_weight')} FROM profile GROUP BY product_id")
_add("agg21_23_daily_summary", lambda s, d: anomaly.daily_summary(anomaly.profile(_state(s, d))), f"{_SCORED} SELECT date_key, {_r('sum(quantity)', 'total')}, CAST(sum(CAST(flag AS INT)) AS BIGINT) AS exceedances, {_r('max(score)', 'max_score')}, {_r('max(systemic_score)', 'systemic_score')}, bool_or(systemic_flag) AS systemic_flag, bool_or(known_event) AS any_event FROM profile GROUP BY date_key")
_add("agg22_audit_counts", lambda s, d: anomaly.profile(_state(s, d)).agg(F.count("*").alias("rows"), F.count("score").alias("scored"), F.sum(F.col("flag").cast("int")).alias("local"), F.count_distinct(F.when(F.col("systemic_flag"), F.col("date_key"))).alias("systemic_days"), F.min("weight").alias("least"), F.avg("weight").alias("mean"), F.max("weight").alias("most")), f"{_SCORED} SELECT count(*) AS rows, count(score) AS scored, CAST(sum(CAST(flag AS INT)) AS BIGINT) AS local, count(DISTINCT CASE WHEN systemic_flag THEN date_key END) AS systemic_days, {_r('min(weight)', 'least')}, {_r('avg(weight)', 'mean')}, {_r('max(weight)', 'most')} FROM profile")
_PROMO = {"campaign_web": f"avg(CAST({_WEB} AS INT))", "campaign_app": f"avg(CAST({_APP} AS INT))", "app_only": f"avg(CAST({_APP} AND NOT ({_WEB}) AS INT))", "discount_web": "avg(discount_web)", "discount_app": "avg(discount_app)", "app_advantage": "avg(discount_app - discount_web)"}
_add(
    "agg3_promo_intensity",
    lambda s, d: anomaly.with_promo_intensity(_filled(s, d)).select("product_id", "date_key", *[f"market_{c}" for c in _PROMO]),
    f"{_FILLED}, m AS (SELECT date_key, {', '.join(f'{v} AS {k}' for k, v in _PROMO.items())} FROM filled GROUP BY date_key) SELECT product_id, date_key, {', '.join(_r(f'm.{c}', f'market_{c}') for c in _PROMO)} FROM filled JOIN m USING (date_key)",
)
_MARKET = """m AS (SELECT date_key, sum(qty_available) AS demand, sum(is_available) AS n_available FROM state GROUP BY date_key),
market AS (SELECT *, demand / nullif(n_available, 0) AS per_available, lag(demand) OVER (ORDER BY date_key) AS demand_lag_1, lag(demand, 7) OVER (ORDER BY date_key) AS demand_lag_7,
  avg(demand) OVER (ORDER BY date_key ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS demand_mean_7, avg(demand) OVER (ORDER BY date_key ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS demand_mean_28 FROM m)"""
_MARKET_COLUMNS = ["demand", "per_available", "demand_lag_1", "demand_lag_7", "demand_mean_7", "demand_mean_28"]
_add(
    "agg4_market_state",
    lambda s, d: anomaly.with_own_left_out(_state(s, d), anomaly.market_state(_state(s, d))).select("product_id", "date_key", "n_available", *_MARKET_COLUMNS, "demand_7_28", "demand_without_own"),
    f"{_STATE}, {_MARKET} SELECT product_id, date_key, CAST(n_available AS BIGINT) AS n_available, {', '.join(_r(c, c) for c in _MARKET_COLUMNS)}, {_r(_ratio('demand_mean_7', 'demand_mean_28'), 'demand_7_28')}, {_r('demand - coalesce(qty_available, 0)', 'demand_without_own')} FROM state JOIN market USING (date_key)",
)

# panels and evaluation --------------------------------------------------------------------------------------------

#: The panel of `history` (a relation with the columns of `based`, and is_future): every origin of history and horizon.
_SEASONS = [7, 14, 21, 28, 364, 365, 371]
_PRICES = {"price": "price", "price_web": _PW, "price_app": _PA}
_RATIOS = (("price_vs_origin", "price", "price"), ("price_vs_lag_7", "price", "price_lag_7"), ("price_vs_median_28", "price", "price_median_28"), ("price_web_vs_median_28", "price_web", "price_web_median_28"), ("price_app_vs_median_28", "price_app", "price_app_median_28"))
_PRICED = "priced AS (SELECT *, " + ", ".join(f"{v} AS x_{k}" for k, v in _PRICES.items()) + " FROM based), pst AS (SELECT *, lag(x_price, 7) OVER (" + _W + ") AS x_price_lag_7, " + ", ".join(f"median(x_{k}) OVER {_incl(28)} AS x_{k}_median_28" for k in _PRICES) + f", {_SORTED.format('l364, l365, l371')} AS q FROM priced), t AS (SELECT *, {_MED.format('q')} AS annual FROM pst)"
_PANEL_ROWS = "x AS (SELECT t.*, CAST(h AS BIGINT) AS horizon, CAST(t.date_key - CAST(h AS INT) AS DATE) AS origin FROM t, range(1, 8) r(h))"
#: In the order of the panel's columns.
_PANEL_COLUMNS = ", ".join([
    "o.product_id", "o.date_key AS origin", "x.horizon", "x.date_key AS target_date",
    *[_r(c, n) for c, n in (("x.quantity", "target"), ("x.quantity_app", "target_app"), ("x.quantity_web", "target_web"), ("o.qty_available", "lag_0"), ("coalesce(x.b4321, o.at_origin)", "target_baseline"))],
    "x.b4321 IS NULL AS target_baseline_missing", "x.available", "x.is_promo", "CAST(x.campaign_web AS BIGINT) AS campaign_web", "CAST(x.campaign_app AS BIGINT) AS campaign_app",
    *[_r(f"x.{c}", c) for c in ("discount_web", "discount_app", "price", "annual")], *[_r(f"x.l{k}", f"season_{k}") for k in _SEASONS],
    "x.annual IS NULL AS annual_missing", _r(_ratio("coalesce(x.b4321, o.at_origin)", "x.annual"), "baseline_annual"),
    *[f"x.l{k} IS NULL AS season_{k}_missing" for k in (364, 365, 371)], *[_r(_ratio(f"x.x_{a}", f"o.x_{b}"), n) for n, a, b in _RATIOS],
])

_add("pnl2_win6_12_21_direct_panel", lambda s, d: direct.direct_panel(_state(s, d), price=True), f"{_LAGGED}, {_PRICED}, {_PANEL_ROWS} SELECT {_PANEL_COLUMNS} FROM t o JOIN x ON o.product_id = x.product_id AND o.date_key = x.origin")
_CUT = "2001-06-30"


def _split(s, d):
    """History up to a day, and the week after it as it is known ahead; the state is written, as both are read again and again."""
    rows = written(_state(s, d))
    return rows.where(F.col("date_key") <= F.lit(_CUT).cast("date")), rows.where(F.col("date_key").between(F.date_add(F.lit(_CUT).cast("date"), 1), F.date_add(F.lit(_CUT).cast("date"), 7)))


#: `state` with what is not known after the cut taken out, and later days left out.
_KNOWN = (
    _FILLED
    + f""",
cutoff AS (SELECT DATE '{_CUT}' AS cut),
known AS (SELECT product_id, date_key, date_key > cut AS is_future, CASE WHEN date_key <= cut THEN available END AS available, CASE WHEN date_key <= cut THEN quantity_app END AS quantity_app,
  CASE WHEN date_key <= cut THEN quantity_web END AS quantity_web, CASE WHEN date_key <= cut THEN quantity END AS quantity, is_gap, is_promo, campaign_web, campaign_app, discount_web, discount_app, price
  FROM filled, cutoff WHERE date_key <= cut + 7),
state AS (SELECT *, CAST(NOT is_gap AS INT) AS observed, CASE WHEN NOT is_gap AND available THEN quantity END AS qty_available FROM known)"""
    + _LAGGED[len(_STATE) :]
)
_LAST = "last_ AS (SELECT product_id, max(date_key) AS last FROM state WHERE NOT is_future GROUP BY product_id)"


def _future_panel(s, d):
    history, ahead = _split(s, d)
    return direct.direct_panel(history, 7, ahead, at_last=True, price=True)


_FUTURE = f"{_KNOWN}, {_PRICED}, {_PANEL_ROWS}, {_LAST}"
_FROM_LAST = "FROM t o JOIN last_ ON o.product_id = last_.product_id AND o.date_key = last_.last JOIN x ON o.product_id = x.product_id AND o.date_key = x.origin"
_add("set1_pnl2_future_panel", _future_panel, f"{_FUTURE} SELECT {_PANEL_COLUMNS} {_FROM_LAST}")
_add("pnl8_step_panel", lambda s, d: recursive.step_panel(*_split(s, d)).select("product_id", "origin", "horizon", "target_date", "lag_0", "target_baseline", "season_7", "price"), f"{_FUTURE} SELECT o.product_id, o.date_key AS origin, x.horizon, x.date_key AS target_date, {_r('o.qty_available', 'lag_0')}, {_r('coalesce(x.b4321, o.at_origin)', 'target_baseline')}, {_r('x.l7', 'season_7')}, {_r('x.price', 'price')} {_FROM_LAST} WHERE x.horizon = 1")
_add("pnl15_jn7_final_naive", lambda s, d: direct.final_naive(*_split(s, d)), f"{_FUTURE}, keys AS (SELECT product_id, date_key AS target_date FROM filled, cutoff WHERE date_key > cut AND date_key <= cut + 7), made AS (SELECT o.product_id, x.date_key AS target_date, x.horizon, coalesce(x.b4321, o.at_origin) AS a, coalesce(x.l7, x.b4321) AS b, o.inc28 AS c {_FROM_LAST}) SELECT product_id, target_date, horizon, {_r('greatest(coalesce(a, 0.0), 0.0)', 'pred_baseline')}, {_r('greatest(coalesce(b, 0.0), 0.0)', 'pred_seasonal_naive')}, {_r('greatest(coalesce(c, 0.0), 0.0)', 'pred_moving_avg')} FROM keys LEFT JOIN made USING (product_id, target_date)")


def _origin_rows(s, d):
    names = ["origin_mean_7", "origin_std_28", "origin_median_14", "origin_gap_rate_28", "lag_0", "lag_6", "unavailable_streak", "observed_days", "share_7", "app_mean_28", "trend_7_28", "slope_28", "demand_mean_7", "demand_without_own"]
    return direct.origin_state(_state(s, d)).select("product_id", "date_key", *names)


_add("pnl1_origin_state", _origin_rows, f"""{_STATE}, {_MARKET}, st AS (SELECT *, CASE WHEN is_available = 1 THEN quantity_app END AS app, sum(1 - is_unavailable) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM state)
SELECT product_id, date_key, {_r(_avg(7), 'origin_mean_7')}, {_r(f'coalesce(stddev_samp(qty_available) OVER {_incl(28)}, 0.0)', 'origin_std_28')}, {_r(f'median(qty_available) OVER {_incl(14)}', 'origin_median_14')}, {_r(f'sum(CAST(is_gap AS INT)) OVER {_incl(28)} / greatest(1, count(*) OVER {_incl(28)})', 'origin_gap_rate_28')},
  {_r('qty_available', 'lag_0')}, {_r(_lag(6), 'lag_6')}, CAST(sum(is_unavailable) OVER (PARTITION BY product_id, island ORDER BY date_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS unavailable_streak,
  CAST(sum(observed) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS observed_days, {_r(f'CASE WHEN sum(qty_available) OVER {_incl(7)} > 0 THEN sum(app) OVER {_incl(7)} / sum(qty_available) OVER {_incl(7)} END', 'share_7')}, {_r(f'avg(app) OVER {_incl(28)}', 'app_mean_28')},
  {_r(_ratio(_avg(7), _avg(28)), 'trend_7_28')}, {_r(f'CASE WHEN count(qty_available) OVER {_incl(28)} >= 2 THEN regr_slope(ln(1 + qty_available), {_DAYNO}) OVER {_incl(28)} END', 'slope_28')}, {_r('demand_mean_7', 'demand_mean_7')}, {_r('demand - coalesce(qty_available, 0)', 'demand_without_own')} FROM st JOIN market USING (date_key)""")


def _weights(s, d):
    p = direct.trainable(direct.direct_panel(_state(s, d)), "2000-12-03", 365)
    return direct.recency_weights(p, "2000-12-03", 90).select("product_id", "origin", "horizon", "sample_weight")


_add("pnl4_prj20_recency_weights", _weights, f"{_LAGGED}, {_AHEAD}, p AS (SELECT o.product_id, o.date_key AS origin, t.horizon, pow(2.0, -(DATE '2000-12-03' - t.date_key) / 90.0) AS w FROM based o JOIN ahead t ON o.product_id = t.product_id AND o.date_key = t.origin WHERE t.available AND t.quantity IS NOT NULL AND t.date_key <= DATE '2000-12-03' AND DATE '2000-12-03' - t.date_key < 365) SELECT product_id, origin, horizon, {_r('w / avg(w) OVER ()', 'sample_weight')} FROM p")
_add("pnl5_11_12_naive_oof", lambda s, d: _oof(s, d), f"{_OOF} SELECT product_id, origin, horizon, target_date, available, {_r('actual', 'actual')}, {_r('pred_baseline', 'pred_baseline')}, {_r('pred_seasonal_naive', 'pred_seasonal_naive')}, {_r('pred_moving_avg', 'pred_moving_avg')} FROM oof")
_add(FLAGSHIP, lambda s, d: _long(s, d).where("common").groupBy("model").agg(*evaluate.metrics()), f"{_OOF} SELECT model, {_METRICS} FROM long WHERE common GROUP BY model")
_SUMMARY = f"""{_OOF}, masked AS (
  SELECT *, 'realized' AS regime, 'model_specific' AS population FROM long
  UNION ALL SELECT *, 'realized', 'common' FROM long WHERE common
  UNION ALL SELECT *, 'conditional', 'model_specific' FROM long WHERE coalesce(available, false)
  UNION ALL SELECT *, 'conditional', 'common' FROM long WHERE coalesce(available, false) AND common)"""


_COUNTS = "count(*) AS expected, count(actual) AS with_actual, count(pred) AS with_pred"
_COVER = _r(f"(count(actual) {_OK}) / nullif(count(actual), 0)", "coverage")


def _summary_sql(key: str) -> str:
    raw = _METRICS.replace("round(", "(").replace(", 6) + 0.0", ")")
    names = ["mae", "rmse", "mape", "wape", "smape", "rmsle", "bias", "bias_ratio"]
    k = f"{key}, " if key else ""
    return f"{_SUMMARY}, folds AS (SELECT model, {k}regime, population, origin, {raw}, {_COUNTS} FROM masked GROUP BY ALL) SELECT model, {k}regime, population, {_METRICS}, {_COUNTS}, 'global' AS aggregation, {_COVER} FROM masked GROUP BY model, {k}regime, population UNION ALL SELECT model, {k}regime, population, CAST(sum(n) AS BIGINT), {', '.join(f'round(avg({c}), 6) + 0.0' for c in names)}, {', '.join(f'CAST(sum({c}) AS BIGINT)' for c in ('expected', 'with_actual', 'with_pred'))}, 'mean_fold', round(sum(n) / nullif(sum(with_actual), 0), 6) FROM folds GROUP BY model, {k}regime, population"


_add("agg7_8_prj21_oof_summary", lambda s, d: evaluate.summary(_long(s, d)), _summary_sql(""))
_add("agg9_by_stratum", lambda s, d: evaluate.summary(_long(s, d).withColumn("stratum", scalar.stratum(F.col("origin"))), ["stratum"]), _summary_sql("stratum").replace("long AS (\n  SELECT product_id", "long AS (\n  SELECT " + _STRATUM + " AS stratum, product_id"))
_add("agg10_by_horizon", lambda s, d: evaluate.summary(_long(s, d), ["horizon"]), _summary_sql("horizon"))
_add("agg11_by_product", lambda s, d: evaluate.summary(_long(s, d), ["product_id"]).where("aggregation = 'global' and population = 'common'"), f"{_SUMMARY} SELECT model, product_id, regime, population, {_METRICS}, {_COUNTS}, 'global' AS aggregation, {_COVER} FROM masked WHERE population = 'common' GROUP BY model, product_id, regime, population")
_add("agg12_fold_table", lambda s, d: evaluate.fold_table(_long(s, d)), f"{_OOF}, rg AS (SELECT *, 'realized' AS regime FROM long UNION ALL SELECT *, 'conditional' FROM long WHERE coalesce(available, false)) SELECT model, origin, regime, {_METRICS}, dense_rank() OVER (PARTITION BY model, regime ORDER BY origin DESC) AS fold FROM rg GROUP BY model, origin, regime")
_add("agg13_test_aligned", lambda s, d: evaluate.test_aligned(_long(s, d)), f"{_OOF}, st AS (SELECT model, {_STRATUM} AS stratum, sum(abs(pred - actual)) / nullif(sum(abs(actual)), 0) AS wape FROM long WHERE common GROUP BY 1, 2), w AS (SELECT *, CASE stratum WHEN 'winter' THEN 0.6 WHEN 'regular' THEN 0.25 ELSE 0.15 END::DOUBLE AS w FROM st WHERE wape IS NOT NULL) SELECT model, {_r('sum(w * wape) / sum(w)', 'test_aligned_wape')}, count(*) AS strata FROM w GROUP BY model")
_add("agg17_top_decile", lambda s, d: evaluate.top_decile(_long(s, d)), f"{_OOF}, c AS (SELECT * FROM long WHERE common), q AS (SELECT quantile_cont(actual, 0.9) AS t FROM c) SELECT model, {_METRICS}, {_r('any_value(t)', 'threshold')} FROM c, q WHERE actual >= t GROUP BY model")
_add("agg18_grouping_sets", lambda s, d: evaluate.cube(_long(s, d)).drop("grouping"), f"{_OOF} SELECT model, origin, horizon, product_id, {_METRICS} FROM long WHERE common GROUP BY GROUPING SETS ((model), (model, origin), (model, horizon), (model, product_id))")
_add("agg24_skill", lambda s, d: evaluate.skill(_long(s, d).where("common").groupBy("model").agg(*evaluate.metrics())).select("model", "mae", "skill"), f"{_OOF}, m AS (SELECT model, avg(abs(pred - actual)) AS mae FROM long WHERE common GROUP BY model) SELECT model, {_r('mae', 'mae')}, {_r('1 - mae / nullif((SELECT mae FROM m WHERE model = %s), 0)' % (chr(39) + 'seasonal_naive' + chr(39)), 'skill')} FROM m")
_add("srt1_largest_errors", lambda s, d: evaluate.largest_errors(_long(s, d).withColumn("pred", F.round("pred", 6))).select("model", "product_id", "origin", "horizon", "error", "rank"), f"{_OOF}, e AS (SELECT *, round(pred, 6) - actual AS error FROM long WHERE common), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(error) DESC, product_id, origin, horizon) AS rank FROM e) SELECT model, product_id, origin, horizon, {_r('error', 'error')}, rank FROM r WHERE rank <= 100")
_add("win22_tail_mean", lambda s, d: direct.tail_mean(_state(s, d)), f"{_STATE}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date_key DESC) AS r FROM state) SELECT product_id, {_r('avg(qty_available)', 'tail_mean')} FROM r WHERE r <= 28 GROUP BY product_id")

# blends -----------------------------------------------------------------------------------------------------------

_GRID = "grid AS (SELECT concat_ws('-', a, b, 10 - a - b) AS candidate, a / 10.0::DOUBLE AS w_baseline, b / 10.0::DOUBLE AS w_seasonal_naive, (10 - a - b) / 10.0::DOUBLE AS w_moving_avg FROM range(0, 11) x(a), range(0, 11) y(b) WHERE a + b <= 10)"
_FIT = f"""{_OOF}, {_GRID}, k AS (SELECT *, {_STRATUM} AS stratum FROM oof WHERE available AND actual IS NOT NULL AND pred_baseline IS NOT NULL AND pred_seasonal_naive IS NOT NULL AND pred_moving_avg IS NOT NULL),
v AS (SELECT stratum, sum(abs(actual)) AS volume, CASE stratum WHEN 'winter' THEN 0.6 WHEN 'regular' THEN 0.25 ELSE 0.15 END::DOUBLE AS w FROM k GROUP BY stratum HAVING sum(abs(actual)) > 0),
c AS (SELECT k.*, w / (SELECT sum(w) FROM v) / volume AS coef FROM k JOIN v USING (stratum)),
b AS (SELECT candidate, w_baseline, w_seasonal_naive, w_moving_avg, actual, coef, pred_baseline * w_baseline + pred_seasonal_naive * w_seasonal_naive + pred_moving_avg * w_moving_avg AS blend FROM c, grid),
f AS (SELECT candidate, w_baseline, w_seasonal_naive, w_moving_avg, sum(coef * abs(blend - actual)) AS aligned, sum(abs(blend - actual)) / sum(abs(actual)) AS broad, any_value(w_baseline * w_baseline + w_seasonal_naive * w_seasonal_naive + w_moving_avg * w_moving_avg) AS concentration FROM b GROUP BY ALL)"""
_COLS = ", ".join(_r(c, c) for c in ("w_baseline", "w_seasonal_naive", "w_moving_avg", "aligned", "broad", "concentration"))
_add("ens1_3_5_convex_fit", lambda s, d: blend.fit(_oof(s, d), MODELS), f"{_FIT} SELECT candidate, {_COLS} FROM f")
_add("ens3_srt4_best_blend", lambda s, d: blend.best(blend.fit(_oof(s, d), MODELS)), f"{_FIT} SELECT candidate, {_COLS} FROM f ORDER BY round(f.aligned, 12), f.concentration, candidate LIMIT 1")
_add("ens4_7_applied_blend", lambda s, d: _oof(s, d).select("product_id", "origin", "horizon", blend.apply_weights(_oof(s, d), {"baseline": 0.5, "moving_avg": 0.3, "seasonal_naive": 0.2}).alias("blend")), f"{_OOF} SELECT product_id, origin, horizon, {_r('CASE WHEN pred_moving_avg IS NOT NULL AND pred_seasonal_naive IS NOT NULL THEN greatest(pred_baseline * 0.5 + pred_moving_avg * 0.3 + pred_seasonal_naive * 0.2, 0.0) END', 'blend')} FROM oof")
_add("ens11_reconciliation", lambda s, d: blend.reconciliation(_oof(s, d), "pred_baseline"), f"{_OOF}, s AS (SELECT horizon, sum(actual) AS a, sum(pred_baseline) AS p FROM oof WHERE available GROUP BY horizon) SELECT horizon, {_r('a', 'a')}, {_r('p', 'p')}, {_r('least(greatest(1 + abs(a) / (abs(a) + 5000) * (a / nullif(p, 0) - 1), 0.85), 1.15)', 'scale')} FROM s")
_add("ens13_leave_one_out", lambda s, d: blend.leave_one_out(_oof(s, d), MODELS), f"{_OOF}, o AS (SELECT model, origin, sum(abs(pred - actual)) AS e, sum(abs(actual)) AS v FROM long WHERE common GROUP BY 1, 2) SELECT model, origin, {_r('(sum(e) OVER (PARTITION BY model) - e) / nullif(sum(v) OVER (PARTITION BY model) - v, 0)', 'wape_without')} FROM o")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
