"""Convex blends of forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.scalar import stratum
from quayside.operators.candidates import error_sums, named, weights_of
from quayside.plans.evaluate import STRATA


def simplex(spark: SparkSession, members: list[str], steps: int = 10) -> DataFrame:
    """candidate, w_<member>: all weights in 1/steps that sum to 1 (bounded by steps and members)."""
    out = spark.range(1).select(F.lit(0).alias("left"))
    for m in members[:-1]:
        out = out.withColumn(f"k_{m}", F.explode(F.sequence(F.lit(0), F.lit(steps) - F.col("left")))).withColumn("left", F.col("left") + F.col(f"k_{m}"))
    last = members[-1]
    out = out.withColumn(f"k_{last}", F.lit(steps) - F.col("left"))
    name = F.concat_ws("-", *[F.col(f"k_{m}").cast("string") for m in members])
    return out.select(name.alias("candidate"), *[(F.col(f"k_{m}") / steps).alias(f"w_{m}") for m in members])


def coefficients(oof: DataFrame) -> DataFrame:
    """oof with `coef`: the stratum's weight (renormed over strata with volume) over its volume."""
    rows = oof.withColumn("stratum", stratum(F.col("origin")))
    volume = rows.groupBy("stratum").agg(F.sum(F.abs("actual")).alias("volume")).where("volume > 0")
    w = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(v)) for k, v in STRATA.items()])
    volume = volume.withColumn("w", w)
    total = volume.agg(F.sum("w").alias("total"))
    return rows.join(F.broadcast(volume.crossJoin(F.broadcast(total))), "stratum").withColumn("coef", F.col("w") / F.col("total") / F.col("volume"))


def fit(oof: DataFrame, members: list[str], steps: int = 10) -> DataFrame:
    """Score of every candidate on rows where all members and the actual are known: sum of coef * |error|.
    One pass of matrix products."""
    known = reduce(lambda a, b: a & b, [F.col(f"pred_{m}").isNotNull() for m in members], F.col("actual").isNotNull() & F.col("available"))
    rows = coefficients(oof.where(known))
    names, weights = weights_of(simplex(oof.sparkSession, members, steps), members)
    sums = named(error_sums(rows, [f"pred_{m}" for m in members], weights, [], coef="coef"), names, weights, members)
    square = sum((F.col(f"w_{m}") * F.col(f"w_{m}") for m in members[1:]), F.col(f"w_{members[0]}") * F.col(f"w_{members[0]}"))
    return sums.select("candidate", *[f"w_{m}" for m in members], F.col("a").alias("aligned"), (F.col("e") / F.nullif("v", F.lit(0.0))).alias("broad"), square.alias("concentration"))


def best(scored: DataFrame) -> DataFrame:
    """The candidate of least score; among equals the most even."""
    return scored.orderBy(F.round("aligned", 12), "concentration", "candidate").limit(1)


def apply_weights(oof: DataFrame, weights: dict[str, float]) -> Column:
    """Blend of the members, at least 0; null unless all are known."""
    total = sum((F.col(f"pred_{m}") * float(w) for m, w in weights.items()), F.lit(0.0))
    return F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))


def reconciliation(oof: DataFrame, pred: str) -> DataFrame:
    """Per horizon: the scale actual over predicted, shrunk by volume / (volume + 5000), within 0.85 to 1.15."""
    s = oof.where(F.col("available")).groupBy("horizon").agg(F.sum("actual").alias("a"), F.sum(pred).alias("p"))
    shrink = F.abs("a") / (F.abs("a") + 5000)
    return s.withColumn("scale", F.least(F.greatest(1 + shrink * (F.col("a") / F.nullif("p", F.lit(0.0)) - 1), F.lit(0.85)), F.lit(1.15)))


def leave_one_out(oof: DataFrame, members: list[str]) -> DataFrame:
    """Each member's WAPE without an origin: totals minus the origin's own, in one pass."""
    from quayside.plans.evaluate import long_form

    rows = long_form(oof, members).where("common")
    own = rows.groupBy("model", "origin").agg(F.sum(F.abs(F.col("pred") - F.col("actual"))).alias("e"), F.sum(F.abs("actual")).alias("v"))
    total = own.groupBy("model").agg(F.sum("e").alias("te"), F.sum("v").alias("tv"))
    return own.join(F.broadcast(total), "model").select("model", "origin", ((F.col("te") - F.col("e")) / F.nullif(F.col("tv") - F.col("v"), F.lit(0.0))).alias("wape_without"))
