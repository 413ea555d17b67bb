"""Direct panels: one row per product, origin and horizon, from one window pass and an explode.

What a row knows of the past, it knows at its origin: the origin's own state, and lags of the target day that reach back
to the origin or further. Of the target day it knows the covariates that are known ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalar import prices, safe_log_ratio
from quayside.operators.windows import baseline, channel_history, days, lags, lifecycle, middle, rolling_state, trends
from quayside.sources.panel import COVARIATES, sanitize_future

SEASONAL = (7, 14, 21, 28)
ANNUAL = (364, 365, 371)
#: Log ratios of the target day's price to the origin's: name, target's column, origin's column.
PRICE_RATIOS = (
    ("price_vs_origin", "price", "origin_price"),
    ("price_vs_lag_7", "price", "origin_price_lag_7"),
    ("price_vs_median_28", "price", "origin_price_median_28"),
    ("price_web_vs_median_28", "price_web", "origin_price_web_median_28"),
    ("price_app_vs_median_28", "price_app", "origin_price_app_median_28"),
)


def with_future(state: DataFrame, future: DataFrame) -> DataFrame:
    """History and future rows together; of future rows only what is known ahead, the rest null."""
    ahead = sanitize_future(future).withColumn("is_future", F.lit(True))
    return state.withColumn("is_future", F.lit(False)).unionByName(ahead, allowMissingColumns=True)


def target_features(state: DataFrame, variant: str = "w4321") -> DataFrame:
    """Seasonal lags and the baseline relative to the target day: the same for every horizon up to a week."""
    lag = {f"season_{d}": F.lag("qty_available", d).over(days()) for d in (*SEASONAL, *ANNUAL)}
    out = state.withColumns({**lag, "same_weekday": baseline(variant)})
    return out.withColumn("annual", middle([F.col(f"season_{d}") for d in ANNUAL]))


def origin_fallback() -> Column:
    """What stands in for a target's baseline: the origin's 7-day median, mean, own quantity, else 0."""
    w = days().rowsBetween(-6, 0)
    return F.coalesce(F.percentile("qty_available", F.lit(0.5)).over(w), F.avg("qty_available").over(w), F.col("qty_available"), F.lit(0.0))


def price_state() -> dict[str, Column]:
    """The origin's price, a week ago, and 28-day medians of the price and both effective prices."""
    w, price = days().rowsBetween(-27, 0), prices()
    median = lambda c: F.percentile(c, F.lit(0.5)).over(w)
    return {
        "origin_price": F.col("price"), "origin_price_lag_7": F.lag("price", 7).over(days()), "origin_price_median_28": median(F.col("price")),
        "origin_price_web_median_28": median(price["price_web"]), "origin_price_app_median_28": median(price["price_app"]),
    }


def direct_panel(
    state: DataFrame, horizons: int = 7, future: DataFrame | None = None, origins: list[str] | None = None, keep: tuple[str, ...] = (), variant: str = "w4321", price: bool = False, at_last: bool = False
) -> DataFrame:
    """product_id, origin, horizon, target_date, the target's quantities and availability, the covariates of the target
    day, lags and baselines; horizons 1..7.

    future: rows of the days after, with the covariates known ahead; their targets are null. Origins are days of
    history only: `origins`, or each product's last day (`at_last`), or all. keep: columns of the origin's row that come
    along. price: log ratios of the target's prices to the origin's. The target row's features travel in a struct
    through lead(), so one sort serves all horizons.
    """
    if not 1 <= horizons <= 7:
        raise ValueError("horizons: 1 to 7")
    rows = state.withColumn("is_future", F.lit(False)) if future is None else with_future(state, future)
    own = {"lag_0": F.col("qty_available"), "origin_fallback": origin_fallback(), **(price_state() if price else {})}
    seasons = [f"season_{d}" for d in (*SEASONAL, *ANNUAL)]
    effective = {k: v for k, v in prices().items() if k in ("price_web", "price_app")}
    rows = target_features(rows, variant).withColumns({**own, **effective})
    fields = ["date_key", "quantity", "quantity_app", "quantity_web", "available", *COVARIATES, *effective, "same_weekday", "annual", *seasons]
    packed = rows.withColumn("__row", F.struct(*[c for c in fields if c in rows.columns]))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("__row", h).over(days()).alias("row")) for h in range(1, horizons + 1)])
    here = ~F.col("is_future")
    if origins is not None:
        here &= F.col("date_key").isin([F.lit(o).cast("date") for o in origins])
    base = packed.withColumn("__ahead", ahead)
    if at_last:
        base = base.withColumn("__last", F.max(F.when(~F.col("is_future"), F.col("date_key"))).over(Window.partitionBy("product_id")))
        here &= F.col("date_key") == F.col("__last")
    base = base.where(here).select("product_id", F.col("date_key").alias("origin"), *own, *keep, "__ahead")
    out = base.withColumn("x", F.explode("__ahead")).where("x.row is not null")
    t = lambda c: F.col(f"x.row.{c}")
    names = [f.name for f in packed.schema["__row"].dataType.fields]
    renamed = {"date_key": "target_date", "quantity": "target", "quantity_app": "target_app", "quantity_web": "target_web"}
    rest = [c for c in names if c not in renamed and c not in effective and c != "same_weekday"]
    missing = {f"season_{d}_missing": t(f"season_{d}").isNull() for d in ANNUAL}
    target_baseline = F.coalesce(t("same_weekday"), F.col("origin_fallback"))
    ratios = {n: safe_log_ratio(t(a), F.col(b)) for n, a, b in PRICE_RATIOS} if price else {}
    return out.select(
        "product_id", "origin", "x.horizon", *[t(c).alias(n) for c, n in renamed.items() if c in names], "lag_0", target_baseline.alias("target_baseline"), t("same_weekday").isNull().alias("target_baseline_missing"),
        *[t(c).alias(c) for c in rest], t("annual").isNull().alias("annual_missing"), safe_log_ratio(target_baseline, t("annual")).alias("baseline_annual"),
        *[v.alias(k) for k, v in {**missing, **ratios}.items()], *keep,
    )


def origin_state(state: DataFrame) -> DataFrame:
    """Everything that is known at the end of a day, beside its row: rolling states, point lags, availability, channels,
    trends and the market's state with the product's own quantity taken out."""
    from quayside.operators.anomaly import market_state

    rolled = {f"origin_{k}": v for n in (7, 14, 28) for k, v in rolling_state(n, inclusive=True).items()}
    out = lifecycle(state).withColumns({**rolled, **lags("qty_available", [0, 1, 2, 6, 7]), **channel_history(), **trends()})
    out = out.join(market_state(state), "date_key")  # a row per day
    return out.withColumn("demand_without_own", F.col("demand") - F.coalesce("qty_available", F.lit(0.0)))


def trainable(panel: DataFrame, cutoff, last_days: int | None = None) -> DataFrame:
    """Rows to fit on: a known target and baseline up to the cutoff, available, and within the last days."""
    ok = F.col("available") & F.col("target").isNotNull() & F.col("target_baseline").isNotNull() & (F.col("target_date") <= F.lit(cutoff).cast("date"))
    if last_days is not None:
        ok &= F.datediff(F.lit(cutoff).cast("date"), "target_date") < last_days
    return panel.where(ok)


def mean_one(df: DataFrame, weight: Column, name: str = "sample_weight") -> DataFrame:
    """df with the weight scaled to mean 1."""
    raw = df.withColumn(name, weight)
    return raw.crossJoin(F.broadcast(raw.agg(F.avg(name).alias("__mean")))).withColumn(name, F.col(name) / F.col("__mean")).drop("__mean")  # one row


def recency_weights(df: DataFrame, cutoff, half_life: float | None) -> DataFrame:
    age = F.greatest(F.datediff(F.lit(cutoff).cast("date"), "target_date"), F.lit(0))
    return mean_one(df, F.lit(1.0) if half_life is None else F.pow(F.lit(2.0), -age / float(half_life)))


def _naive(panel: DataFrame) -> dict[str, Column]:
    """Weighted same-weekday baseline, the value a week before (or else the mean of its weekdays), the last 28 days' mean."""
    same = F.when(~F.col("target_baseline_missing"), F.col("target_baseline"))
    return {"pred_baseline": F.col("target_baseline"), "pred_seasonal_naive": F.coalesce("season_7", same), "pred_moving_avg": F.col("mean_28_0")}


def naive_forecasts(state: DataFrame, origins: list[str], horizons: int = 7) -> DataFrame:
    """Out-of-fold rows of three deterministic models at the origins: seasonal naive, 28-day mean, weighted baseline. A
    prediction is null where the model's own past has nothing to go by."""
    rows = state.withColumn("mean_28_0", F.avg("qty_available").over(days().rowsBetween(-27, 0)))
    panel = direct_panel(rows, horizons, origins=origins, keep=("mean_28_0",))
    return panel.select("product_id", "origin", "horizon", "target_date", "available", F.col("target").alias("actual"), *[v.alias(k) for k, v in _naive(panel).items()])


def final_naive(state: DataFrame, future: DataFrame, horizons: int = 7) -> DataFrame:
    """The same three for the days after each product's last one, on the keys of `future`; unknown is 0, none is negative."""
    rows = state.withColumn("mean_28_0", F.avg("qty_available").over(days().rowsBetween(-27, 0)))
    panel = direct_panel(rows, horizons, future, keep=("mean_28_0",), at_last=True)
    made = panel.select("product_id", "target_date", "horizon", *[F.greatest(v, F.lit(0.0)).alias(k) for k, v in _naive(panel).items()])
    keys = future.select("product_id", F.col("date_key").alias("target_date"))
    names = list(_naive(panel))
    return align(made, keys, ["product_id", "target_date"]).fillna(0.0, names)


def align(predictions: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Predictions on the wanted keys, by key and never by order."""
    return keys.join(predictions, on, "left")


def tail_mean(state: DataFrame, n: int = 28) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy(F.desc("date_key"))
    return state.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("product_id").agg(F.avg("qty_available").alias("tail_mean"))
