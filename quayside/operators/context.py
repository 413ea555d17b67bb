"""Descriptions of a panel's context: category shares, robust scales, lifts, ranks, top days and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles


def long_values(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """feature, value: the columns' values as rows, cast to one type."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*")


def category_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value, share: null counts as 'missing'."""
    counts = long_values(df, columns, "string").groupBy("feature", F.coalesce("value", F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(total, "feature").select("feature", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median, scale: interquartile range over 1.349; if zero the population deviation; if zero 1. Quantiles are
    exact, of all rows."""
    out = None
    for c in columns:
        q = exact_quantiles(df, c, {"low": 0.25, "median": 0.5, "high": 0.75})
        sd = df.agg(F.stddev_pop(F.col(c).cast("double")).alias("sd"), F.count(c).alias("known"))
        spread = (F.col("high") - F.col("low")) / 1.349
        one = q.crossJoin(F.broadcast(sd)).where("known > 0").select(F.lit(c).alias("feature"), "median", F.coalesce(F.when(spread > 0, spread), F.when(F.col("sd") > 0, F.col("sd")), F.lit(1.0)).alias("scale"))  # one row
        out = one if out is None else out.unionByName(one)
    return out


def weekly_lift(state: DataFrame) -> DataFrame:
    """Per product: the last 7 days' mean over the 7 days before them, and the share of known days at or under the last
    known value."""
    last = state.groupBy("product_id").agg(F.max("date_key").alias("last"), F.max_by("qty_available", F.when(F.col("qty_available").isNotNull(), F.col("date_key"))).alias("latest"))
    rows, age = state.join(last, "product_id"), F.datediff("last", "date_key")
    mean = lambda a, b: F.avg(F.when(age.between(a, b), F.col("qty_available")))
    out = rows.groupBy("product_id").agg(mean(0, 6).alias("recent_mean"), mean(7, 13).alias("before"), F.avg((F.col("qty_available") <= F.col("latest")).cast("double")).alias("percentile"))
    return out.withColumn("lift", F.col("recent_mean") / F.nullif("before", F.lit(0.0)) - 1)


def empirical_rank(by: str, value: str) -> Column:
    """Share of the group's known values at or under the row's; null where the row has none."""
    known = F.col(value).isNotNull()
    return F.when(known, F.cume_dist().over(Window.partitionBy(by, known).orderBy(value)))


def top_days(profile: DataFrame, n: int = 20) -> DataFrame:
    """The n largest scores of each product."""
    w = Window.partitionBy("product_id").orderBy(F.desc("score"), "date_key")
    return profile.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def split_of(date: Column, train_end: str, validation_end: str, calibration_end: str) -> Column:
    """train, validation, calibration or holdout, by inclusive ends."""
    ends = {"train": train_end, "validation": validation_end, "calibration": calibration_end}
    return F.coalesce(*[F.when(date <= F.lit(e).cast("date"), F.lit(k)) for k, e in ends.items()], F.when(date.isNotNull(), F.lit("holdout")), F.lit("ignored"))


def channel_share_errors(rows: DataFrame, actual: str, pred: str, volume: str) -> DataFrame:
    """One row: plain and volume-weighted MAE, bias, means and coverage of predicted shares."""
    ok = F.col(actual).isNotNull() & F.col(pred).isNotNull()
    e = F.when(ok, F.col(pred) - F.col(actual))
    v = F.when(ok, F.col(volume))
    return rows.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), (F.sum(v * F.abs(e)) / F.nullif(F.sum(v), F.lit(0.0))).alias("weighted_mae"), F.avg(e).alias("bias"), F.avg(F.when(ok, F.col(actual))).alias("mean_actual"), F.avg(F.when(ok, F.col(pred))).alias("mean_pred"), (F.count(e) / F.count(actual)).alias("coverage"))


def prediction_diagnostics(long: DataFrame) -> DataFrame:
    """Per model: rows, known predictions, the largest, its 99th percentile and ratio to the largest actual."""
    return long.groupBy("model").agg(F.count("*").alias("n_rows"), F.count("pred").alias("n_known"), F.max("pred").alias("largest"), F.percentile("pred", F.lit(0.99)).alias("p99"), (F.max("pred") / F.nullif(F.max("actual"), F.lit(0.0))).alias("ratio"))


def role_overlaps(roles: DataFrame, days: int = 7) -> DataFrame:
    """role_a, role_b, target_date of roles (role, origin) whose target days meet: none means a clean protocol."""
    days_of = roles.select("role", F.explode(F.sequence(F.date_add("origin", 1), F.date_add("origin", days))).alias("target_date")).distinct()
    a, b = days_of.withColumnRenamed("role", "role_a"), days_of.withColumnRenamed("role", "role_b")
    return a.join(b, "target_date").where("role_a < role_b")
