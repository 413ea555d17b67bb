"""Window features on the gap-filled calendar: rows are days, and one sort by (product, day) serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalar import availability, safe_log_ratio, weighted_present



def days():
    return Window.partitionBy("product_id").orderBy("date_key")


#: Weights of the same weekday one to four weeks ago, by variant.
BASELINES = {"w4321": (4, 3, 2, 1), "w8421": (8, 4, 2, 1), "lag7": (1, 0, 0, 0)}


def with_state(filled: DataFrame) -> DataFrame:
    return filled.withColumns(availability())


def rolling_state(width: int, inclusive: bool = False) -> dict[str, Column]:
    """Mean, sample deviation (one value: 0), median, counts and rates over the days before (or up to) the row."""
    w = days().rowsBetween(-(width - 1), 0) if inclusive else days().rowsBetween(-width, -1)
    rows = F.greatest(F.lit(1), F.count(F.lit(1)).over(w))
    out = {
        f"mean_{width}": F.avg("qty_available").over(w),
        f"std_{width}": F.coalesce(F.when(F.count("qty_available").over(w) > 1, F.stddev_samp("qty_available").over(w)), F.lit(0.0)),
        f"median_{width}": F.percentile("qty_available", F.lit(0.5)).over(w),
    }
    counted = {c: F.col(c) for c in ("is_available", "observed", "is_unavailable")} | {"gap": F.col("is_gap").cast("int")}
    for name, c in counted.items():
        out[f"{name}_{width}"] = F.sum(c).over(w)
        out[f"{name}_rate_{width}"] = F.coalesce(F.sum(c).over(w), F.lit(0)) / rows
    return out | {f"stockout_rate_{width}": out[f"is_unavailable_rate_{width}"]}


def lags(column: str, back: list[int]) -> dict[str, Column]:
    return {f"lag_{d}": F.lag(column, d).over(days()) if d else F.col(column) for d in back}


def baseline(variant: str = "w4321", column: str = "qty_available") -> Column:
    """Mean of the same weekday one to four weeks ago, weights renormed over those that are there."""
    values = [F.lag(column, 7 * k).over(days()) for k in (1, 2, 3, 4)]
    if variant == "median":
        return middle(values)
    return weighted_present([(v, w) for v, w in zip(values, BASELINES[variant]) if w])


def middle(values: list[Column]) -> Column:
    """Median of the values that are there."""
    a = F.array_sort(F.array_compact(F.array(*values)))
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def baseline_with_fallback(variant: str = "w4321") -> Column:
    """The baseline of the day, else what the day before knew: 7-day median, mean, its own quantity, else 0."""
    return F.coalesce(baseline(variant), F.percentile("qty_available", F.lit(0.5)).over(days().rowsBetween(-7, -1)), F.avg("qty_available").over(days().rowsBetween(-7, -1)), F.lag("qty_available").over(days()), F.lit(0.0))


def lifecycle(df: DataFrame) -> DataFrame:
    """Age of the last available and observed day, counts so far, the unavailable streak and the return flag."""
    past = days().rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("is_unavailable") == 1
    out = df.withColumns({
        "last_available": F.last(F.when(F.col("is_available") == 1, F.col("date_key")), True).over(past),
        "last_observed": F.last(F.when(F.col("observed") == 1, F.col("date_key")), True).over(past),
        "observed_days": F.sum("observed").over(past),
        "available_days": F.sum("is_available").over(past),
        "island": F.sum((~off).cast("int")).over(past),
        "returned": ((F.col("is_available") == 1) & (F.lag("is_unavailable").over(days()) == 1)),
    })
    streak = F.sum(off.cast("int")).over(Window.partitionBy("product_id", "island").orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({
        "days_since_available": F.datediff("date_key", "last_available"),
        "days_since_observed": F.datediff("date_key", "last_observed"),
        "ever_available": F.col("last_available").isNotNull(),
        "unavailable_streak": streak,
        "returned": F.coalesce("returned", F.lit(False)),
    }).drop("island", "last_available", "last_observed")


def channel_history() -> dict[str, Column]:
    """App share now, a week ago and over 7 and 28 days by volume, and channel means."""
    app, total = F.when(F.col("is_available") == 1, F.col("quantity_app")), F.col("qty_available")
    share = F.when(total > 0, app / total)
    out = {"share_lag_0": share, "share_lag_7": F.lag(share, 7).over(days())}
    for n in (7, 28):
        w = days().rowsBetween(-(n - 1), 0)
        sold = F.sum(total).over(w)
        out[f"share_{n}"] = F.when(sold > 0, F.sum(app).over(w) / sold)
        out[f"app_mean_{n}"] = F.avg(app).over(w)
        out[f"web_mean_{n}"] = F.avg(total - app).over(w)
    out["share_delta"] = out["share_7"] - out["share_28"]
    out["share_count_28"] = F.count(share).over(days().rowsBetween(-27, 0))
    return out


def price_history() -> dict[str, Column]:
    w = days().rowsBetween(-27, 0)
    return {"price_lag_7": F.lag("price", 7).over(days()), **{f"{c}_median_28": F.percentile(c, F.lit(0.5)).over(w) for c in ("price", "price_web", "price_app")}}


def trends() -> dict[str, Column]:
    mean = lambda n: F.avg("qty_available").over(days().rowsBetween(-(n - 1), 0))
    out = {"trend_7_28": safe_log_ratio(mean(7), mean(28)), "trend_14_28": safe_log_ratio(mean(14), mean(28)), "trend_0_28": safe_log_ratio(F.col("qty_available"), mean(28))}
    day = F.datediff("date_key", F.lit("1970-01-01").cast("date")).cast("double")
    for n in (7, 28):
        w = days().rowsBetween(-(n - 1), 0)
        y = F.log1p("qty_available")
        out[f"slope_{n}"] = F.when(F.count("qty_available").over(w) >= 2, F.regr_slope(y, F.when(F.col("qty_available").isNotNull(), day)).over(w))
    return out


def annual_reference() -> dict[str, Column]:
    values = [F.lag("qty_available", d).over(days()) for d in (364, 365, 371)]
    ref = middle(values)
    return {"annual": ref, "annual_missing": ref.isNull(), "baseline_annual": safe_log_ratio(baseline(), ref)}


def expectation() -> Column:
    """What was to be expected of a day, from earlier ones only."""
    before = lambda n: days().rowsBetween(-n, -1)
    median = lambda n: F.percentile("qty_available", F.lit(0.5)).over(before(n))
    return F.coalesce(baseline(), F.when(F.count("qty_available").over(before(28)) >= 4, median(28)), median(7))


def robust_score(rows: DataFrame, residual: str, width: int = 180, least: int = 28, floor: float = 0.10) -> DataFrame:
    """rows with center, scale (past interquartile deviation, at least floor) and score: the distance of the residual
    from the past median in scales; null before `least` known days.

    The quantiles of a sliding frame come from one that is kept sorted, product by product; a product is as long as its
    calendar.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in ("center", "scale", "score")]])

    def one(group):
        import pyarrow as pa

        group = group.sort_by("date_key")
        r = group.column(residual).to_pandas().astype(float)
        past = r.rolling(width, min_periods=1)
        q = {k: past.quantile(k).shift(1) for k in (0.25, 0.5, 0.75)}
        known = past.count().shift(1) >= least
        scale = ((q[0.75] - q[0.25]) / 1.349).clip(lower=floor)
        for name, v in (("center", q[0.5]), ("scale", scale), ("score", (r - q[0.5]).abs() / scale)):
            group = group.append_column(name, pa.array(v.where(known), pa.float64(), from_pandas=True))
        return group

    return rows.groupBy("product_id").applyInArrow(one, schema)


def days_since(df: DataFrame, flag: Column, name: str, w=None) -> DataFrame:
    """df with the rows since the flag was last up: 0 on it, null before the first."""
    w = w or days()
    numbered = df.withColumn("__n", F.row_number().over(w)).withColumn("__at", F.when(flag, F.col("__n")))
    return numbered.withColumn(name, F.col("__n") - F.last("__at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n", "__at")
