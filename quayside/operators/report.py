"""Reports on single products and single errors: an anomaly report of every product, and what stood around an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a report's timeline holds of a profile's day, in this order.
TIMELINE = (
    "date_key", "quantity", "expected", "residual", "score", "flag", "flag_rate_28", "days_since_flag", "known_event", "systemic_score", "systemic_flag", "systemic_rate_28", "weight",
)


def product_reports(profile: DataFrame, future: DataFrame, n: int = 20) -> DataFrame:
    """product_id, observed_days, exceedances, on_events, max_score, mean_weight, timeline (its days, ascending), top (the n
    flagged days of highest score, ties to the earlier), future (the rows of `future`, by date_key): all products at once.

    A product without a row in `future` has an empty array there; a product only in `future` has no report. Unknown flags
    count as false. A product's days are one group: thousands of rows, however many products there are.
    """
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    flags = ("flag", "known_event", "systemic_flag")
    rows = profile.select("product_id", *[false(c) if c in flags else F.col(c) for c in TIMELINE])
    out = rows.groupBy("product_id").agg(
        F.count("quantity").alias("observed_days"), F.count_if("flag").alias("exceedances"), F.count_if(F.col("flag") & F.col("known_event")).alias("on_events"),
        F.max("score").alias("max_score"), F.avg("weight").alias("mean_weight"), F.sort_array(F.collect_list(F.struct(*TIMELINE))).alias("timeline"),
    )
    by_score = F.array_sort(F.transform(F.filter("timeline", lambda x: x["flag"]), lambda x: F.struct((-x["score"]).alias("k"), x.alias("x"))))
    out = out.withColumn("top", F.slice(F.transform(by_score, lambda x: x["x"]), 1, n))
    fields = ["date_key", *[c for c in future.columns if c not in ("product_id", "date_key")]]
    ahead = future.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("future"))
    return out.join(ahead, "product_id", "left").withColumn("future", F.coalesce("future", F.array().cast(ahead.schema["future"].dataType)))


def _lift(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and lift: the mean of the 7 days up to the origin over that of the 7 before, less 1."""
    age = F.datediff("origin", "date_key")
    mean = lambda a, b: F.avg(F.when(age.between(a, b), F.col(value)))
    return rows.groupBy(*keys).agg((mean(0, 6) / F.nullif(mean(7, 13), F.lit(0.0)) - 1).alias("lift"))


def error_context(errors: DataFrame, state: DataFrame) -> DataFrame:
    """errors (product_id, origin, horizon, actual, ...: few rows, such as the largest) with product_lift, portfolio_lift (week
    over week at the origin, null without either week) and actual_percentile (share of the product's known days up to the
    origin that are at or under the actual; null where that is unknown).

    The history meets the errors by product, for the lifts only on the 14 days that count.
    """
    own = state.select("product_id", "date_key", "quantity").where("quantity is not null")
    origins = errors.select("product_id", "origin").distinct()
    near = lambda: F.col("date_key").between(F.date_sub("origin", 13), F.col("origin"))
    product = _lift(own.join(origins, "product_id").where(near()), ["product_id", "origin"], "quantity")
    days = F.explode(F.sequence(F.date_sub("origin", 13), F.col("origin")))
    market = own.groupBy("date_key").agg(F.sum("quantity").alias("total")).join(origins.select("origin").distinct().withColumn("date_key", days), "date_key")
    portfolio = _lift(market, ["origin"], "total")
    key = ["product_id", "origin", "horizon"]
    asked = errors.select(*key, "actual").where("actual is not null").distinct()
    known = own.join(asked, "product_id").where("date_key <= origin")
    percentile = known.groupBy(*key).agg(F.avg((F.col("quantity") <= F.col("actual")).cast("double")).alias("actual_percentile"))
    out = errors.join(product.withColumnRenamed("lift", "product_lift"), ["product_id", "origin"], "left")
    return out.join(portfolio.withColumnRenamed("lift", "portfolio_lift"), "origin", "left").join(percentile, key, "left")


def largest_errors(oof: DataFrame, pred: str, n: int = 20) -> DataFrame:
    """The n largest absolute errors of each origin, ties by product and horizon, with `error` (prediction less actual)."""
    rows = oof.where(F.col("available") & F.col("actual").isNotNull() & F.col(pred).isNotNull()).withColumn("error", F.col(pred) - F.col("actual"))
    w = Window.partitionBy("origin").orderBy(F.desc(F.round(F.abs("error"), 6)), "product_id", "horizon")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def temporal_split(
    days: DataFrame, holdout_days: int = 180, calibration_days: int = 180, validation_fraction: float = 0.15, least: int = 120, training_days: int | None = 1095
) -> DataFrame:
    """days (date_key; a row a day) with split: train, validation, calibration, holdout or ignored.

    The last holdout_days are held out, the calibration_days before them calibrate, what is earlier (at most training_days
    back) trains, its last validation_fraction (12 days at least, a third at most) validates. Where this leaves fewer than
    max(20, least) days to train or 20 to calibrate or hold out, shares of the days stand in for dates: 65, 20 and 15 %.
    ValueError for shares of fewer than 60 days, or too few training days after all.
    """
    if not 0 < validation_fraction < 0.5 or holdout_days < 20 or calibration_days < 20:
        raise ValueError("validation_fraction must lie in (0, 0.5), holdout_days and calibration_days must be 20 at least")
    last = days.agg(F.max("date_key").alias("__last"))
    age = F.datediff("__last", "date_key")
    held, calibrates = age < holdout_days, age.between(holdout_days, holdout_days + calibration_days - 1)
    pooled = age >= holdout_days + calibration_days
    if training_days is not None:
        pooled &= age < holdout_days + calibration_days + training_days
    n, pool, calibration, holdout = days.crossJoin(F.broadcast(last)).agg(F.count("*"), F.count_if(pooled), F.count_if(calibrates), F.count_if(held)).first()  # one row
    start, wanted = n - holdout - calibration - pool, max(20, least)
    if pool < wanted or calibration < 20 or holdout < 20:
        if n < 60:
            raise ValueError(f"{n} days: 60 at least can be split")
        start, pool = 0, min(max(wanted, int(n * 0.65)), n - 40)
        calibration = min(max(pool + 20, int(n * 0.85)), n - 20) - pool
    validation = min(max(12, round(pool * validation_fraction)), max(1, pool // 3))
    if pool - validation < max(10, least // 2):
        raise ValueError(f"only {pool - validation} days are left to train on")
    # a row a day: years of days are a few thousand rows
    rows = days.withColumn("__at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date_key")) - 1)
    ends = [(start, "ignored"), (start + pool - validation, "train"), (start + pool, "validation"), (start + pool + calibration, "calibration")]
    return rows.withColumn("split", F.coalesce(*[F.when(F.col("__at") < end, F.lit(name)) for end, name in ends], F.lit("holdout"))).drop("__at")


def _each(array: Column, f) -> Column:
    """f over the places (0 ..) of every inner array's values."""
    return F.transform(array, lambda row: F.transform(row, f))


def prepared_windows(windows: DataFrame, train_end: str, clip: float = 8.0) -> DataFrame:
    """windows (date_key, window: days of a row of values each) filled, centred, scaled and clipped by place of a value.

    Medians, means and population deviations are those of all points of the windows that end up to train_end, a day
    counting once for each window it stands in; values that are null or not finite take the median, 0 where there is
    none; a deviation of 1e-6 or less is 1. ValueError without a training window.
    """
    from quayside.functions.quantiles import group_quantiles
    from quayside.functions.scalar import finite

    train = windows.where(F.col("date_key") <= F.lit(train_end).cast("date"))
    first = train.select(F.size(F.get("window", F.lit(0))).alias("n")).first()
    if first is None:
        raise ValueError(f"no window ends up to {train_end}")
    points = train.select(F.explode("window").alias("row")).select(F.posexplode("row").alias("place", "raw")).select("place", finite(F.col("raw")).alias("v"))
    middle = {r.place: r.median for r in group_quantiles(points, ["place"], "v", {"median": 0.5}).collect()}  # a row a place
    median = F.array(*[F.lit(float(middle.get(i, 0.0))) for i in range(first.n)])
    filled = points.select("place", F.coalesce("v", F.get(median, "place")).alias("v"))
    stats = {r.place: (r.mean, r.sd) for r in filled.groupBy("place").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).collect()}
    mean = F.array(*[F.lit(stats[i][0]) for i in range(first.n)])
    scale = F.array(*[F.lit(stats[i][1] if stats[i][1] > 1e-6 else 1.0) for i in range(first.n)])
    z = lambda v, i: (F.coalesce(finite(v), F.get(median, i)) - F.get(mean, i)) / F.get(scale, i)
    return windows.withColumn("window", _each(F.col("window"), lambda v, i: F.greatest(F.lit(-clip), F.least(F.lit(clip), z(v, i)))))
