"""Daily multivariate representations, sliding windows of them, and how well a linear code rebuilds a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.anomaly import daily_window
from quayside.operators.windows import baseline

#: What each mode is made of.
MODES = {
    "log_level": ("level",), "weekday_residual": ("weekday_residual",), "level_residual": ("level", "weekday_residual"),
    "residual_availability": ("weekday_residual", "available"), "level_residual_availability": ("level", "weekday_residual", "available"),
}


def representation(state: DataFrame, mode: str = "level_residual_availability") -> DataFrame:
    """date_key, product_id, kind, value of every product's days: log quantity, its distance from the log of the weighted
    same-weekday baseline, availability as 0 or 1. Unknown values are null; nothing is imputed."""
    if mode not in MODES:
        raise ValueError(f"no such representation: {mode}")
    level = F.log1p(F.greatest("qty_available", F.lit(0.0)))
    level = F.when(F.col("qty_available").isNotNull(), level)
    base = F.col("__base")
    made = {"level": level, "weekday_residual": F.when(base.isNotNull(), level - F.log1p(F.greatest(base, F.lit(0.0)))), "available": F.col("is_available").cast("double")}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), made[k].alias("value")) for k in MODES[mode]])
    return state.withColumn("__base", baseline()).select("date_key", "product_id", F.explode(pairs).alias("x")).select("date_key", "product_id", "x.*")


def preparation(rows: DataFrame, train_end: str) -> DataFrame:
    """product_id, kind, median, mean, scale from the days up to train_end: the median fills what is unknown (0 without any),
    then mean and population deviation (1 where it is next to zero)."""
    train = rows.where(F.col("date_key") <= F.lit(train_end).cast("date"))
    keys = ["product_id", "kind"]
    middle = train.groupBy(*keys).agg(F.coalesce(F.percentile("value", F.lit(0.5)), F.lit(0.0)).alias("median"))  # a product's days
    filled = train.join(middle, keys).withColumn("v", F.coalesce("value", "median"))
    sd = F.stddev_pop("v")
    return filled.groupBy(*keys).agg(F.first("median").alias("median"), F.avg("v").alias("mean"), F.when(sd > 1e-6, sd).otherwise(1.0).alias("scale"))


def prepared(rows: DataFrame, stats: DataFrame, clip: float = 8.0) -> DataFrame:
    """rows with `value` filled, centred, scaled and clipped by the statistics of the training days."""
    out = rows.join(stats, ["product_id", "kind"])
    z = (F.coalesce("value", "median") - F.col("mean")) / F.col("scale")
    return out.withColumn("value", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("median", "mean", "scale")


def sliding(daily: DataFrame, columns: list[str], width: int = 28) -> DataFrame:
    """date_key, window: the last `width` days' values of the columns, oldest first; only whole windows. A row a day."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    rows = daily.select("date_key", vector.alias("v"), F.lit(0).alias("__all"))
    w = daily_window().rowsBetween(-(width - 1), 0)
    return rows.select("date_key", F.collect_list("v").over(w).alias("window")).where(F.size("window") == width)


def reconstruction(windows: DataFrame, train_end: str, k: int = 16) -> DataFrame:
    """date_key, score: half the mean, half the 95 % quantile of a window's squared errors after a linear code of k numbers,
    fitted on the windows up to train_end. Values are scaled by the training windows first; null values count as 0."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    flat = F.transform(F.flatten("window"), lambda x: F.coalesce(x, F.lit(0.0)))
    rows = windows.select("date_key", array_to_vector(flat).alias("raw"))
    train = rows.where(F.col("date_key") <= F.lit(train_end).cast("date"))
    scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="x").fit(train)
    code = PCA(k=k, inputCol="x", outputCol="code").fit(scaler.transform(train))
    parts = code.pc.toArray()  # as many rows as a window has numbers, k columns
    out = code.transform(scaler.transform(rows)).select("date_key", vector_to_array("x").alias("x"), vector_to_array("code").alias("code"))
    lines = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in parts])
    back = F.transform(lines, lambda line: F.aggregate(F.zip_with(line, F.col("code"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    error = F.array_sort(F.zip_with("x", back, lambda a, b: (a - b) * (a - b)))
    mean = F.aggregate(error, F.lit(0.0), lambda s, x: s + x) / F.size(error)
    high = F.get(error, F.floor(F.lit(0.95) * (F.size(error) - 1)).cast("int"))
    return out.select("date_key", (0.5 * mean + 0.5 * high).alias("score"))


def feature_columns(groups: tuple[str, ...] = ()) -> list[str]:
    """The direct panel's feature columns in order: always the lags and the baseline, then the groups asked for (price,
    campaign, annual)."""
    own = ["lag_0", "target_baseline", "season_7", "season_14", "season_21", "season_28"]
    more = {
        "price": ["price", "discount_web", "discount_app", "price_vs_origin", "price_vs_lag_7", "price_vs_median_28", "price_web_vs_median_28", "price_app_vs_median_28"],
        "campaign": ["is_promo", "campaign_web", "campaign_app"],
        "annual": ["annual", "baseline_annual", "season_364", "season_365", "season_371"],
    }
    unknown = [g for g in groups if g not in more]
    if unknown:
        raise ValueError(f"no such feature groups: {unknown}")
    return [*own, *[c for g in more if g in groups for c in more[g]]]
