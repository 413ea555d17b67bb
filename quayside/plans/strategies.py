"""Forecasts of several strategies as one long table with what guarded them, and the tables of a report over it: by
split (origin_type), strategy and model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import group_quantiles
from quayside.functions.scalar import finite, stratum, submission
from quayside.plans.evaluate import metrics

KEYS = ("product_id", "origin", "horizon", "target_date")
#: What guarded a prediction: flags, and the numbers behind them.
FLAGS = ("fallback_used", "nonfinite", "catastrophic", "residual_guard", "residual_nonfinite")
NUMBERS = ("residual_min", "residual_max", "safety_limit")
SPLIT = ("origin_type", "strategy")


def with_guards(rows: DataFrame) -> DataFrame:
    """rows with every guard column: a flag that the strategy does not set is false, a number null."""
    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False) for c in FLAGS}
    numbers = {c: finite(F.col(c).cast("double")) if c in rows.columns else F.lit(None).cast("double") for c in NUMBERS}
    return rows.withColumns({**flags, **numbers})


def strategy_rows(parts: dict[str, list[DataFrame]], origin_type: Column) -> DataFrame:
    """One row per strategy, key and model: origin_type, available, actual, pred and all guards.

    parts: by strategy, tables with KEYS, available, actual, model, pred and the guards that they have. origin_type: an
    expression over the origin.
    """
    columns = ["strategy", "origin_type", *KEYS, "available", "actual", "model", "pred", *FLAGS, *NUMBERS]
    every = [with_guards(t).withColumns({"strategy": F.lit(s), "origin_type": origin_type}).select(*columns) for s, tables in parts.items() for t in tables]
    return reduce(DataFrame.unionByName, every)


def with_common(rows: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """rows of the strategies' models with `common`: available, with an actual, and predicted by each model of the
    strategy."""
    mine = reduce(lambda a, b: a | b, [(F.col("strategy") == s) & F.col("model").isin(m) for s, m in models.items()])
    wanted = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(len(set(m)))) for s, m in models.items()])
    key = Window.partitionBy("strategy", "product_id", "origin", "horizon")
    known = F.size(F.collect_set(F.when(finite(F.col("pred")).isNotNull(), F.col("model"))).over(key))  # a row per model
    return rows.where(mine).withColumn("common", F.coalesce("available", F.lit(False)) & finite(F.col("actual")).isNotNull() & (known == wanted))


def blended(rows: DataFrame, weights: dict[str, dict[str, float]], name: str = "ensemble") -> DataFrame:
    """Rows of one more model: each strategy's members by its weights, null unless all of them are finite. A blend has no
    guards of its own: flags false, numbers null."""
    pairs = [(s, m, w) for s, own in weights.items() for m, w in own.items()]
    weight = F.coalesce(*[F.when((F.col("strategy") == s) & (F.col("model") == m), F.lit(float(w))) for s, m, w in pairs])
    wanted = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(len(own))) for s, own in weights.items()])
    value = finite(F.col("pred")) * F.col("__w")
    by = ["strategy", "origin_type", *KEYS]
    out = rows.withColumn("__w", weight).where("__w is not null").groupBy(*by).agg(F.first("available").alias("available"), F.first("actual").alias("actual"), F.sum(value).alias("pred"), F.count(value).alias("__n"))
    out = out.withColumns({"pred": F.when(F.col("__n") == wanted, F.col("pred")), "model": F.lit(name)}).drop("__n")
    return with_guards(out).select(*rows.columns)


def forecast_table(rows: DataFrame) -> DataFrame:
    """One row per strategy, model and key: the raw prediction, whole units (half to even) and the guards."""
    return rows.select("strategy", "model", *KEYS, F.col("pred").alias("raw"), submission(F.col("pred")).alias("quantity"), *FLAGS, *NUMBERS)


def diagnostics(rows: DataFrame, by: tuple[str, ...] = SPLIT) -> DataFrame:
    """By the keys and model: rows, finite predictions and their share, guards by count and rate, the extremes of raw
    residuals and of predictions, the 99th percentile, and the ratio of the largest prediction to the largest actual of
    all the group's models."""
    keys = [*by, "model"]
    pred, n = finite(F.col("pred")), F.count(F.lit(1))
    counts = {c: F.count_if(c) for c in FLAGS}
    out = rows.groupBy(*keys).agg(
        n.alias("n_rows"), F.count(pred).alias("n_finite"), (F.count(pred) / n).alias("coverage"), *[c.alias(f"{k}_count") for k, c in counts.items()],
        *[(counts[k] / n).alias(f"{k}_rate") for k in ("fallback_used", "residual_guard")], F.min("residual_min").alias("residual_min"), F.max("residual_max").alias("residual_max"),
        F.min("safety_limit").alias("safety_limit"), F.max(pred).alias("largest"), F.max(finite(F.col("actual").cast("double"))).alias("__top"),
    )
    top = F.max("__top").over(Window.partitionBy(*by))  # a row per model
    out = out.withColumn("observed_max", top).drop("__top").withColumn("ratio", F.when(F.col("observed_max") > 0, F.col("largest") / F.col("observed_max")))
    return out.join(group_quantiles(rows.withColumn("pred", pred), keys, "pred", {"p99": 0.99}), keys, "left")


def _of_one_model(rows: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a | b, [(F.col("strategy") == s) & (F.col("model") == m[0]) for s, m in models.items()]))


def top_demand(rows: DataFrame, models: dict[str, list[str]], quantile: float = 0.9) -> DataFrame:
    """Scores by split, strategy and model over the common rows (`with_common`) whose actual is at or over the quantile of
    the split's and strategy's actuals, a key counted once."""
    if not 0.5 <= quantile < 1:
        raise ValueError("quantile: 0.5 to under 1")
    common = rows.where("common")
    limit = group_quantiles(_of_one_model(common, models), list(SPLIT), "actual", {"threshold": quantile})
    return common.join(limit, list(SPLIT)).where("actual >= threshold").groupBy(*SPLIT, "model").agg(F.first("threshold").alias("threshold"), *metrics())


def largest_errors(rows: DataFrame, n: int = 100) -> DataFrame:
    """The n common rows of largest absolute error by split, strategy and model, with the signed error and rank."""
    error = F.col("pred") - F.col("actual")
    w = Window.partitionBy(*SPLIT, "model").orderBy(F.desc("absolute_error"), "product_id", "origin", "horizon")
    out = rows.where("common").withColumns({"signed_error": error, "absolute_error": F.abs(error), "stratum": stratum(F.col("origin"))})
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def compact(rows: DataFrame) -> DataFrame:
    """strategy, model, scope, value and scores over the model's available rows: all, by_origin, by_horizon, by_stratum
    (one pass), and top_decile, whose value is its cutoff."""
    valid = rows.where(F.coalesce("available", F.lit(False)) & finite(F.col("actual")).isNotNull() & finite(F.col("pred")).isNotNull())
    by = ["strategy", "model"]
    valid = valid.withColumn("stratum", stratum(F.col("origin")))
    parts = ("origin", "horizon", "stratum")
    sets = valid.groupingSets([by, *[[*by, p] for p in parts]], *by, *parts).agg(*metrics(), *[F.grouping(p).alias(f"__{p}") for p in parts])
    scope = F.coalesce(*[F.when(F.col(f"__{p}") == 0, F.lit(f"by_{p}")) for p in parts], F.lit("all"))
    value = F.coalesce(F.col("origin").cast("string"), F.col("horizon").cast("string"), F.col("stratum"))
    measures = ["n", "wape", "mae", "rmse", "bias_ratio"]
    sets = sets.select(*by, scope.alias("scope"), value.alias("value"), F.lit(None).cast("double").alias("cutoff"), *measures)
    limit = group_quantiles(valid, by, "actual", {"cutoff": 0.9})
    top = valid.join(limit, by).where("actual >= cutoff").groupBy(*by).agg(F.first("cutoff").alias("cutoff"), *metrics())
    return sets.unionByName(top.select(*by, F.lit("top_decile").alias("scope"), F.lit(None).cast("string").alias("value"), "cutoff", *measures))


def accepted_ensembles(scores: DataFrame, least: float = 0.002, name: str = "ensemble") -> DataFrame:
    """Strategies whose ensemble is better than their best single model by the share `least`. scores: strategy, model, wape."""
    of = lambda ok: F.min(F.when(ok, F.col("wape")))
    ensemble, single = of(F.col("model") == name), of(F.col("model") != name)
    return scores.groupBy("strategy").agg(ensemble.alias("ensemble"), single.alias("single")).where(F.col("ensemble") <= (1 - least) * F.col("single")).select("strategy")


def canonical(scores: DataFrame, accepted: DataFrame, model: str | None = None, strategy: str | None = None, metric: str = "wape", name: str = "ensemble") -> DataFrame:
    """One row, the model and strategy to go on with: least metric, ties by name.

    scores: strategy, model, metric; a null metric takes no part. model: the one that was asked for; else any, an ensemble only in strategies that
    `accepted` lists. strategy: likewise. No row if the model has no scores in the strategy.
    """
    rows = scores.where(F.col(metric).isNotNull())
    if strategy is not None:
        rows = rows.where(F.col("strategy") == strategy)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    else:
        ok = accepted.select("strategy").distinct().withColumn("__ok", F.lit(True))
        rows = rows.join(ok, "strategy", "left").where((F.col("model") != name) | F.col("__ok")).drop("__ok")
    return rows.orderBy(F.round(metric, 9), "model", "strategy").limit(1)
