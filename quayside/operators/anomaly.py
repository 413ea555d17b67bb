"""A causal anomaly profile of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles
from quayside.functions.scalar import known_event, safe_log_ratio
from quayside.operators.windows import days, days_since, expectation, robust_score
from quayside.sources.panel import require_unique
from quayside.sources.shared import written


def daily_window():
    """Over the daily table, which has a row per day; a constant column stands in for its partition key."""
    return Window.partitionBy("__all").orderBy("date_key")


def scores(state: DataFrame) -> DataFrame:
    """Expected quantity, log residual and past-only robust score of every day."""
    rows = state.withColumn("expected", expectation())
    rows = rows.withColumn("residual", F.log1p("qty_available") - F.log1p("expected"))
    return robust_score(rows, "residual").withColumn("known_event", known_event())


def empirical_threshold(scored: DataFrame, alpha: float = 0.01, column: str = "score") -> DataFrame:
    """One row: the 1 - alpha quantile of the scores."""
    return exact_quantiles(scored, column, {"threshold": 1 - alpha})


def weights(
    score: Column, threshold: Column, residual: Column, event: Column, policy: str = "downweight", strength: float = 1.0, floor: float = 0.2, event_floor: float = 0.65,
    most: float = 2.0, systemic: Column | None = None, systemic_floor: float = 0.5, available: Column | None = None,
) -> Column:
    """Training weight of a row by its excess over the threshold, exponentially: down to `floor` or up to `most`.

    A known event that raised demand keeps at least event_floor, a systemic day at least systemic_floor. Rows without a
    score weigh 1, unavailable days too.
    """
    excess = strength * F.coalesce(F.greatest(score - threshold, F.lit(0.0)) / F.greatest(threshold, F.lit(2.220446049250313e-16)), F.lit(0.0))
    down = F.greatest(F.exp(-excess), F.lit(floor))
    up = F.least(F.exp(F.least(excess, F.log(F.lit(max(most, 1.0))))), F.lit(float(most)))
    one, below, above = F.lit(1.0), F.coalesce(residual < 0, F.lit(False)), F.coalesce(residual > 0, F.lit(False))
    by = {"downweight": down, "negative_only": F.when(below, down).otherwise(one), "hard_example": up, "signed": F.when(below, down).when(above, up).otherwise(one)}[policy]
    out = F.when(score.isNull(), one).otherwise(by)
    out = F.when(F.coalesce(event, F.lit(False)) & above, F.greatest(out, F.lit(event_floor))).otherwise(out)
    if systemic is not None:
        out = F.when(F.coalesce(systemic, F.lit(False)), F.greatest(out, F.lit(systemic_floor))).otherwise(out)
    if available is not None:
        out = F.when(F.coalesce(available, F.lit(False)), out).otherwise(one)
    return out


def profile(state: DataFrame, alpha: float = 0.01, systemic_alpha: float = 0.02, policy: str = "downweight", threshold: str = "empirical") -> DataFrame:
    """Scores, flags, past flag rates, days since the last flag, the day's systemic score and flag, and weights.

    The scores are written once and read for thresholds, days and rows. threshold: "empirical", or "tail" for
    generalised Pareto thresholds of the local and the systemic scores.
    """
    scored = written(scores(state))
    daily = written(scored.groupBy("date_key").agg(F.percentile("score", F.lit(0.9)).alias("systemic_score")))
    local, systemic = _thresholds(scored, daily, alpha, systemic_alpha, threshold)
    out = scored.crossJoin(F.broadcast(local)).withColumn("flag", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))  # one row
    daily = daily.crossJoin(F.broadcast(systemic)).withColumn("systemic_flag", F.coalesce(F.col("systemic_score") > F.col("systemic_threshold"), F.lit(False)))
    daily = daily.withColumn("__all", F.lit(0)).withColumn("systemic_rate_28", F.avg(F.col("systemic_flag").cast("double")).over(daily_window().rowsBetween(-28, -1))).drop("__all", "systemic_threshold")
    out = out.withColumn("flag_rate_28", F.avg(F.col("flag").cast("double")).over(days().rowsBetween(-28, -1)))
    out = days_since(out, F.col("flag"), "days_since_flag").join(daily, "date_key")
    weight = weights(F.col("score"), F.col("threshold"), F.col("residual"), F.col("known_event"), policy, systemic=F.col("systemic_flag"), available=F.col("is_available") == 1)
    return out.withColumn("weight", weight)


def _thresholds(scored: DataFrame, daily: DataFrame, alpha: float, systemic_alpha: float, kind: str) -> tuple[DataFrame, DataFrame]:
    if kind == "tail":
        from quayside.operators.tails import tail_threshold

        return tail_threshold(scored, "score", alpha).select("threshold"), tail_threshold(daily, "systemic_score", systemic_alpha).select(F.col("threshold").alias("systemic_threshold"))
    return empirical_threshold(scored, alpha), empirical_threshold(daily, systemic_alpha, "systemic_score").withColumnRenamed("threshold", "systemic_threshold")


#: Columns of a profile that an origin's row may know.
ORIGIN_COLUMNS = ("score", "flag", "flag_rate_28", "days_since_flag", "systemic_score", "systemic_flag", "systemic_rate_28")


def attach_origin_state(state: DataFrame, prof: DataFrame) -> DataFrame:
    """state with the profile's columns of the same product and day, as origin_<column> doubles; null where it has no row.
    ValueError if the profile has a key twice."""
    own = require_unique(prof, ["product_id", "date_key"]).select("product_id", "date_key", *[F.col(c).cast("double").alias(f"origin_{c}") for c in ORIGIN_COLUMNS])
    return state.join(own, ["product_id", "date_key"], "left")


def attach_target_weights(panel: DataFrame, prof: DataFrame, normalise: bool = True) -> DataFrame:
    """panel with sample_weight multiplied by the weight of the target day (1 where the profile has no row) and scaled to
    mean 1, and the target's score and flag beside it."""
    own = require_unique(prof, ["product_id", "date_key"]).select("product_id", F.col("date_key").alias("target_date"), F.col("weight").alias("__w"), F.col("score").alias("target_score"), F.col("flag").alias("target_flag"))
    base = F.coalesce("sample_weight", F.lit(1.0)) if "sample_weight" in panel.columns else F.lit(1.0)
    out = panel.join(own, ["product_id", "target_date"], "left").withColumn("sample_weight", base * F.coalesce("__w", F.lit(1.0))).drop("__w")
    return _to_mean_one(out) if normalise else out


def attach_daily_weights(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """panel with sample_weight multiplied by the target day's weight of a daily table (date_key, weight)."""
    own = require_unique(daily, ["date_key"]).select(F.col("date_key").alias("target_date"), F.col("weight").alias("__w"))
    base = F.coalesce("sample_weight", F.lit(1.0)) if "sample_weight" in panel.columns else F.lit(1.0)
    return panel.join(own, "target_date", "left").withColumn("sample_weight", base * F.coalesce("__w", F.lit(1.0))).drop("__w")


def attach_daily_state(state: DataFrame, daily: DataFrame, columns: list[str], prefix: str = "day_") -> DataFrame:
    """state with columns of a daily table at the origin's day, under a prefix."""
    own = require_unique(daily, ["date_key"]).select("date_key", *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in columns])
    return state.join(own, "date_key", "left")


def _to_mean_one(panel: DataFrame) -> DataFrame:
    mean = panel.agg(F.avg("sample_weight").alias("__mean"))
    ok = F.col("__mean") > 0
    return panel.crossJoin(F.broadcast(mean)).withColumn("sample_weight", F.when(ok, F.col("sample_weight") / F.col("__mean")).otherwise(F.col("sample_weight"))).drop("__mean")  # one row


def anomaly_layer(state: DataFrame, panel_of, prof: DataFrame, daily: DataFrame | None = None, mode: str = "both", source: str = "statistical") -> DataFrame:
    """A training panel with the anomaly layer on it.

    mode: off, weight, features or both. source: statistical (the profile), reconstruction (a daily table with score,
    weight and flag_rate_28) or hybrid. panel_of: (state, names of origin columns to keep) to the panel. The weights are
    scaled to mean 1 once, at the end.
    """
    if mode not in ("off", "weight", "features", "both") or source not in ("statistical", "reconstruction", "hybrid"):
        raise ValueError(f"no such anomaly layer: {mode}, {source}")
    local, day = source in ("statistical", "hybrid"), source in ("reconstruction", "hybrid")
    keep: list[str] = []
    if mode in ("features", "both"):
        if local:
            state, keep = attach_origin_state(state, prof), [f"origin_{c}" for c in ORIGIN_COLUMNS]
        if day:
            columns = ["score", "flag_rate_28"]
            state, keep = attach_daily_state(state, daily, columns), [*keep, *[f"day_{c}" for c in columns]]
    panel = panel_of(state, tuple(keep))
    if mode in ("weight", "both"):
        if local:
            panel = attach_target_weights(panel, prof, normalise=False)
        if day:
            panel = attach_daily_weights(panel, daily)
        panel = _to_mean_one(panel)
    return panel


def product_summary(p: DataFrame) -> DataFrame:
    flag = F.col("flag").cast("int")
    return p.groupBy("product_id").agg(F.count("score").alias("scored"), F.sum(flag).alias("exceedances"), F.sum((F.col("flag") & F.col("known_event")).cast("int")).alias("on_events"), F.max("score").alias("max_score"), F.avg("weight").alias("mean_weight"))


def daily_summary(p: DataFrame) -> DataFrame:
    flag = F.col("flag").cast("int")
    return p.groupBy("date_key").agg(F.sum("quantity").alias("total"), F.sum(flag).alias("exceedances"), F.max("score").alias("max_score"), F.first("systemic_score").alias("systemic_score"), F.bool_or("systemic_flag").alias("systemic_flag"), F.bool_or("known_event").alias("any_event"))


def market_state(state: DataFrame) -> DataFrame:
    """Per day: demand (null where no product is available), available products, demand per available product, demand a
    day and a week ago, its 7- and 28-day means and their log ratio."""
    day = state.groupBy("date_key").agg(F.sum("qty_available").alias("demand"), F.sum("is_available").alias("n_available")).withColumn("__all", F.lit(0))
    out = day.withColumn("per_available", F.col("demand") / F.nullif("n_available", F.lit(0)))
    mean = lambda n: F.avg("demand").over(daily_window().rowsBetween(-(n - 1), 0))
    out = out.withColumns({"demand_lag_1": F.lag("demand", 1).over(daily_window()), "demand_lag_7": F.lag("demand", 7).over(daily_window()), "demand_mean_7": mean(7), "demand_mean_28": mean(28)})
    return out.withColumn("demand_7_28", safe_log_ratio(F.col("demand_mean_7"), F.col("demand_mean_28"))).drop("__all")


def with_own_left_out(state: DataFrame, market: DataFrame) -> DataFrame:
    """state with the day's market and `demand_without_own`, the market's demand less the product's own."""
    return state.join(market, "date_key").withColumn("demand_without_own", F.col("demand") - F.coalesce("qty_available", F.lit(0.0)))


def promo_intensity(filled: DataFrame) -> DataFrame:
    """Per day, over products: shares with a campaign on the web, in the app, in the app only; mean discounts, and the mean
    advantage of the app's."""
    web, app = F.col("campaign_web") != -1, F.col("campaign_app") != -1
    share = lambda c: F.avg(c.cast("double"))
    return filled.groupBy("date_key").agg(
        share(web).alias("campaign_web"), share(app).alias("campaign_app"), share(app & ~web).alias("app_only"),
        F.avg("discount_web").alias("discount_web"), F.avg("discount_app").alias("discount_app"), F.avg(F.col("discount_app") - F.col("discount_web")).alias("app_advantage"),
    )


def with_promo_intensity(filled: DataFrame) -> DataFrame:
    """filled with the day's promo intensity as market_<column>."""
    day = promo_intensity(filled)
    return filled.join(day.select("date_key", *[F.col(c).alias(f"market_{c}") for c in day.columns[1:]]), "date_key")
