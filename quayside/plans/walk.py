"""Walk-forward runs that can be broken off and taken up again, and recursive forecasts from many origins at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators.anomaly import ORIGIN_COLUMNS, anomaly_layer, profile
from quayside.plans.direct import direct_panel, recency_weights, trainable
from quayside.plans.models import SMALL, Inputs, fit_model
from quayside.plans.recursive import BACK, forecast_with
from quayside.sources.panel import KNOWN_FUTURE
from quayside.sources.shared import written

#: What names a fold.
FOLD = ["strategy", "origin_type", "origin"]
#: A strategy: from an origin to its out-of-fold rows (product_id, horizon, target_date, actual, available, pred).
Strategy = Callable[[str], DataFrame]


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "strategy string, origin_type string, origin date, n_rows long"
    try:
        return spark.read.schema(schema).parquet(f"{path}/done")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def missing_jobs(wanted: DataFrame, path: str) -> DataFrame:
    """The folds of `wanted` (strategy, origin_type, origin) that the store does not have."""
    return wanted.select(*FOLD).distinct().join(_ledger(wanted.sparkSession, path), FOLD, "left_anti")


def stored_folds(wanted: DataFrame, path: str) -> DataFrame:
    """The stored rows of the wanted folds."""
    rows = wanted.sparkSession.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.withColumn("origin", F.col("origin").cast("date")).join(wanted.select(*FOLD).distinct(), FOLD, "left_semi")


def walk_stored(wanted: DataFrame, strategies: dict[str, Strategy], path: str) -> DataFrame:
    """The out-of-fold rows of all wanted folds (strategy, origin_type, origin; few): those that the store at `path` has are
    read, the others are made one by one, in the order of their origins.

    A fold's rows replace its partition as a whole and are entered in a ledger afterwards. So a run that is broken off
    loses the fold at hand at most, and the next run makes just what is missing; a fold made twice is stored once. A fold
    without rows is done, too. KeyError for a strategy that is not there.
    """
    spark = wanted.sparkSession
    for job in sorted(missing_jobs(wanted, path).collect(), key=lambda r: (str(r.origin), r.origin_type, r.strategy)):  # a row a fold
        rows = strategies[job.strategy](str(job.origin))
        rows = rows.drop(*FOLD).withColumns({"strategy": F.lit(job.strategy), "origin_type": F.lit(job.origin_type), "origin": F.lit(str(job.origin))})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*FOLD).parquet(f"{path}/rows")
        key = (F.col("strategy") == job.strategy) & (F.col("origin_type") == job.origin_type) & (F.col("origin") == str(job.origin))
        n = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(key).count() if _has_rows(spark, path) else 0
        spark.createDataFrame([(job.strategy, job.origin_type, job.origin, n)], _ledger(spark, path).schema).coalesce(1).write.mode("append").parquet(f"{path}/done")
    return stored_folds(wanted, path)


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(f"{path}/rows")
    except AnalysisException:
        return False
    return True


def direct_strategy(panel: DataFrame, kind: str, half_life: float = 365.0, trees: int = 400, seeds: tuple[int, ...] = (42,), inputs: Inputs = SMALL) -> Strategy:
    """Fits one model for all horizons on the rows known at the origin."""

    def run(origin: str) -> DataFrame:
        train = recency_weights(trainable(panel, origin), origin, half_life)
        held = panel.where(F.col("origin") == F.lit(origin).cast("date"))
        made = fit_model(train, kind, trees, seeds, inputs).predict(held)
        return made.select("product_id", "horizon", "target_date", F.col("target").alias("actual"), "available", "pred")

    return run


def layered_strategy(
    state: DataFrame, kind: str, half_life: float = 365.0, trees: int = 400, seeds: tuple[int, ...] = (42,), inputs: Inputs = SMALL, mode: str = "both", alpha: float = 0.01, policy: str = "downweight",
    threshold: str = "empirical", horizons: int = 7,
) -> Strategy:
    """As direct_strategy, with the anomaly layer of each origin on it: scores, thresholds, flags and weights come from the
    days up to the origin alone, and so do the panel that is fitted on and the columns of the origin's row.

    mode: "weight" (training rows weigh by their target day), "features" (the origin's profile stands among the inputs),
    "both", or "off".
    """
    seen = replace(inputs, plain=(*inputs.plain, *[f"origin_{c}" for c in ORIGIN_COLUMNS])) if mode in ("features", "both") else inputs

    def run(origin: str) -> DataFrame:
        day = F.lit(origin).cast("date")
        past = state.where(F.col("date_key") <= day)
        prof = written(profile(past, alpha, policy=policy, threshold=threshold))

        def to_fit_on(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
            return recency_weights(trainable(direct_panel(rows, horizons, keep=keep), origin), origin, half_life)

        train = anomaly_layer(past, to_fit_on, prof, mode=mode)
        held = anomaly_layer(state, lambda rows, keep: direct_panel(rows, horizons, origins=[origin], keep=keep), prof, mode="features" if seen is not inputs else "off")
        made = fit_model(train, kind, trees, seeds, seen).predict(held)
        return made.select("product_id", "horizon", "target_date", F.col("target").alias("actual"), "available", "pred")

    return run


def recursive_strategy(state: DataFrame, kind: str, half_life: float = 365.0, trees: int = 400, seeds: tuple[int, ...] = (42,), horizons: int = 7, inputs: Inputs = SMALL) -> Strategy:
    """Fits a one-step model on the rows known at the origin and feeds its predictions back."""

    def run(origin: str) -> DataFrame:
        made = forecast_origins(state, [origin], fitted_steps(state, [origin], kind, half_life, trees, seeds, inputs), horizons)
        actual = state.select("product_id", F.col("date_key").alias("target_date"), F.col("quantity").alias("actual"), "available")
        return made.join(actual, ["product_id", "target_date"], "left").select("product_id", "horizon", "target_date", "actual", "available", "pred")

    return run


def fitted_steps(state: DataFrame, origins: list[str], kind: str, half_life: float = 365.0, trees: int = 400, seeds: tuple[int, ...] = (42,), inputs: Inputs = SMALL) -> Callable[[DataFrame], DataFrame]:
    """A step for `forecast_origins`: a one-step model for each origin, fitted on the rows known there; a row is predicted
    by the model of the origin its series starts from (`first_origin`)."""
    panel = direct_panel(state, 1)
    models = {o: fit_model(recency_weights(trainable(panel, o), o, half_life), kind, trees, seeds, inputs) for o in origins}

    def predict(rows: DataFrame) -> DataFrame:
        out = None
        for o, model in models.items():
            made = model.predict(rows.where(F.col("first_origin") == F.lit(o).cast("date")))
            out = made if out is None else out.unionByName(made)
        return out

    return predict


def forecast_origins(state: DataFrame, origins: list[str], predict: Callable[[DataFrame], DataFrame], horizons: int = 7) -> DataFrame:
    """`forecast_with` from all origins together: a product's history up to an origin is a series of its own, so `horizons`
    rounds serve all origins. The days after an origin are those of `state`, with what is known of them ahead; products
    without a row on the origin's day have no forecast there.

    predict: a one-step panel, with `first_origin` (the origin its series starts from), to the same rows with `pred` and,
    if the model has one, `app_share`. product_id, origin, horizon, target_date, pred, the guards, app_share.
    """
    n = len(origins)
    days = sorted(origins)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).cast("date").alias("o")) for i, o in enumerate(days)])
    named = lambda rows, keep: rows.withColumn("__at", F.explode(F.filter(at, keep))).withColumn("product_id", F.col("product_id") * n + F.col("__at")["i"])
    past = named(state, lambda a: F.col("date_key").between(F.date_sub(a["o"], BACK - 1), a["o"]))
    # what was ever observed up to the origin bounds a step, though the history that travels is shorter
    top = named(state, lambda a: F.col("date_key") <= a["o"]).groupBy("product_id").agg(F.max("quantity").alias("__top"))
    here = past.groupBy("product_id").agg(F.max("date_key").alias("__end"), F.first("__at").alias("__a")).where(F.col("__end") == F.col("__a")["o"]).select("product_id")
    past = past.drop("__at").join(here, "product_id", "left_semi")
    ahead = named(state, lambda a: F.col("date_key").between(F.date_add(a["o"], 1), F.date_add(a["o"], horizons))).select(*KNOWN_FUTURE).join(here, "product_id", "left_semi")
    starts = F.element_at(F.array(*[F.lit(o).cast("date") for o in days]), (F.pmod("product_id", F.lit(n)) + 1).cast("int"))

    def step(panel: DataFrame) -> DataFrame:
        rows = panel.withColumns({"__series": F.col("product_id"), "first_origin": starts}).withColumn("product_id", F.floor(F.col("product_id") / n).cast("long"))
        return predict(rows).withColumn("product_id", F.col("__series")).drop("__series", "first_origin")

    out = forecast_with(past, ahead, step, horizons, top)
    return out.withColumn("product_id", F.floor(F.col("product_id") / n).cast("long"))
