"""Scores of forecasts. Predictions are turned into rows once; every table is one aggregation of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles
from quayside.functions.scalar import finite, scored, stratum

#: Weights of the validation strata in the test-aligned score.
STRATA = {"winter": 0.60, "regular": 0.25, "holiday": 0.15}


def long_form(oof: DataFrame, models: list[str]) -> DataFrame:
    """One row per prediction: model, pred; `common` where every model can be scored."""
    both = scored("actual", [f"pred_{m}" for m in models])
    rows = oof.withColumn("common", both).withColumn("m", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in models])))
    return rows.drop(*[f"pred_{m}" for m in models]).withColumns({"model": F.col("m.model"), "pred": F.col("m.pred")}).drop("m")


def metrics(actual: str = "actual", pred: str = "pred") -> list[Column]:
    """MAE, RMSE, MAPE (per cent, by at least 1), WAPE, sMAPE, RMSLE, bias, bias ratio and n over rows with both numbers."""
    y, p = F.col(actual), F.col(pred)
    ok = finite(y).isNotNull() & finite(p).isNotNull()
    of = lambda e: F.when(ok, e)
    err = F.abs(p - y)
    volume = F.sum(of(F.abs(y)))
    return [
        F.count(of(y)).alias("n"),
        F.avg(of(err)).alias("mae"),
        F.sqrt(F.avg(of((p - y) * (p - y)))).alias("rmse"),
        (100 * F.avg(of(err / F.greatest(y, F.lit(1.0))))).alias("mape"),
        F.when(volume > 0, F.sum(of(err)) / volume).alias("wape"),
        F.avg(of(2 * err / (F.abs(y) + F.abs(p) + 1e-8))).alias("smape"),
        F.sqrt(F.avg(of(F.pow(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(y, F.lit(0.0))), F.lit(2.0))))).alias("rmsle"),
        F.avg(of(p - y)).alias("bias"),
        F.when(volume > 0, F.sum(of(p - y)) / volume).alias("bias_ratio"),
    ]


def summary(long: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Scores by model and keys: realized (all rows) and conditional (available), each over the common and the
    model's own population, pooled ('global') and averaged over origins ('mean_fold'). Beside them rows expected, with an
    actual, with a prediction, scored (both), and the share of the rows with an actual that are scored."""
    masks = F.array(
        F.struct(F.lit("realized").alias("regime"), F.lit("model_specific").alias("population"), F.lit(True).alias("ok")),
        F.struct(F.lit("realized").alias("regime"), F.lit("common").alias("population"), F.col("common").alias("ok")),
        F.struct(F.lit("conditional").alias("regime"), F.lit("model_specific").alias("population"), F.coalesce("available", F.lit(False)).alias("ok")),
        F.struct(F.lit("conditional").alias("regime"), F.lit("common").alias("population"), (F.coalesce("available", F.lit(False)) & F.col("common")).alias("ok")),
    )
    rows = long.withColumn("m", F.explode(masks)).where("m.ok").withColumns({"regime": F.col("m.regime"), "population": F.col("m.population")})
    by = ["model", *keys, "regime", "population"]
    counts = [F.count(F.lit(1)).alias("expected"), F.count(finite(F.col("actual"))).alias("with_actual"), F.count(finite(F.col("pred"))).alias("with_pred")]
    pooled = rows.groupBy(*by).agg(*metrics(), *counts).withColumn("aggregation", F.lit("global"))
    names = ["mae", "rmse", "mape", "wape", "smape", "rmsle", "bias", "bias_ratio"]
    folds = rows.groupBy(*by, "origin").agg(*metrics(), *counts)
    totals = ["n", "expected", "with_actual", "with_pred"]
    mean = folds.groupBy(*by).agg(*[F.sum(c).alias(c) for c in totals], *[F.avg(c).alias(c) for c in names]).withColumn("aggregation", F.lit("mean_fold"))
    return pooled.unionByName(mean).withColumn("coverage", F.col("n") / F.nullif("with_actual", F.lit(0)))


def supported(long: DataFrame, support: DataFrame) -> DataFrame:
    """Only the predictions of the models and strategies that `support` (model, strategy) lists."""
    return long.join(support.select("model", "strategy").distinct(), ["model", "strategy"], "left_semi")


#: Models in the order of reports: the learned ones first, then the naive ones; others after them by name.
DISPLAY = ("ridge", "huber", "factor", "trees_a", "trees_b", "tweedie", "ensemble", "baseline", "seasonal_naive", "moving_avg")


def in_display_order(rows: DataFrame, column: str = "model") -> DataFrame:
    """rows with `place` from 1, by the order of DISPLAY, then by name. A row a model."""
    known = F.array_position(F.array(*map(F.lit, DISPLAY)), F.col(column))
    key = F.struct(F.when(known > 0, known).otherwise(len(DISPLAY) + 1), F.col(column))
    return rows.withColumn("one", F.lit(0)).withColumn("place", F.dense_rank().over(Window.partitionBy("one").orderBy(key))).drop("one")


def fold_table(long: DataFrame) -> DataFrame:
    """Scores per model, origin and regime (all rows, available rows); fold 1 is the latest origin."""
    regimes = F.when(F.coalesce("available", F.lit(False)), F.array(F.lit("realized"), F.lit("conditional"))).otherwise(F.array(F.lit("realized")))
    rows = long.withColumn("regime", F.explode(regimes)).groupBy("model", "origin", "regime").agg(*metrics())
    return rows.withColumn("fold", F.dense_rank().over(Window.partitionBy("model", "regime").orderBy(F.desc("origin"))))


def test_aligned(long: DataFrame) -> DataFrame:
    """Mean of the strata's WAPE by their weights, renormed over the strata that are there."""
    weight = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(v)) for k, v in STRATA.items()])
    each = long.where("common").withColumn("stratum", stratum(F.col("origin"))).groupBy("model", "stratum").agg(*metrics()).where("wape is not null")
    return each.withColumn("w", weight).groupBy("model").agg((F.sum(F.col("w") * F.col("wape")) / F.sum("w")).alias("test_aligned_wape"), F.count("*").alias("strata"))


def top_decile(long: DataFrame) -> DataFrame:
    """Scores over the rows whose actual is in the top tenth."""
    common = long.where("common")
    limit = exact_quantiles(common, "actual", {"limit": 0.9})
    return common.crossJoin(F.broadcast(limit)).where("actual >= limit").groupBy("model").agg(*metrics(), F.first("limit").alias("threshold"))  # one row


def cube(long: DataFrame) -> DataFrame:
    """One pass: all rows, by origin, by horizon and by product."""
    return long.where("common").groupingSets([["model"], ["model", "origin"], ["model", "horizon"], ["model", "product_id"]], "model", "origin", "horizon", "product_id").agg(F.grouping_id().alias("grouping"), *metrics())


def largest_errors(long: DataFrame, n: int = 100) -> DataFrame:
    w = Window.partitionBy("model").orderBy(F.desc("abs_error"), "product_id", "origin", "horizon")
    rows = long.where("common").withColumns({"error": F.col("pred") - F.col("actual"), "abs_error": F.abs(F.col("pred") - F.col("actual"))})
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def skill(summary_rows: DataFrame, reference: str = "seasonal_naive") -> DataFrame:
    """1 - MAE over the reference model's MAE."""
    base = summary_rows.where(F.col("model") == reference).select(F.col("mae").alias("mae_ref"))
    return summary_rows.crossJoin(F.broadcast(base)).withColumn("skill", 1 - F.col("mae") / F.nullif("mae_ref", F.lit(0.0)))
