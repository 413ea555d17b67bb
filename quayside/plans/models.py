"""Residual models on the direct panel, as Spark ML pipelines fitted on the training rows only.

The label is log1p(target) - log1p(target_baseline); predictions are carried back and held to the training residuals'
0.1 and 99.9 % bounds, widened by one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.regression import FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles
from quayside.functions.scalar import EVENTS, app_share, events, finite
from quayside.plans.direct import PRICE_RATIOS, align, direct_panel, origin_state, recency_weights, trainable
from quayside.sources.panel import CAMPAIGN_CODES

NUMERIC = ["lag_0", "target_baseline", "annual", "season_7", "season_14", "season_21", "season_28"]
CATEGORIES = ["horizon", "weekday", "month"]
#: Products that have a code of their own among the categories: ids by their remainder of this.
PRODUCTS = 64
#: Places of hashed ids in a factor machine's vector.
HASHED = 1 << 12


@dataclass(frozen=True)
class Inputs:
    """What a model sees of a panel: numbers of at least 0 (log1p is taken), numbers as they are, categories with their
    fixed domains, and ids that a factor machine embeds."""

    numeric: tuple[str, ...] = tuple(NUMERIC)
    plain: tuple[str, ...] = ()
    domains: tuple[tuple[str, tuple], ...] = (("horizon", tuple(range(1, 8))), ("weekday", tuple(range(7))), ("month", tuple(range(1, 13))))
    ids: tuple[str, ...] = ("product_id", "campaign_web", "campaign_app", "horizon")

    @property
    def numbers(self) -> list[str]:
        return [*self.numeric, *self.plain]


SMALL = Inputs()
_CAMPAIGNS = (-1, *CAMPAIGN_CODES)
#: With categories that trees split on: products and campaigns beside the calendar.
CATEGORICAL = Inputs(domains=(*SMALL.domains, ("product_code", tuple(range(PRODUCTS))), ("campaign_web", _CAMPAIGNS), ("campaign_app", _CAMPAIGNS)))
#: The origin's columns that a wide panel keeps, and all that a model sees there: states, channels, trends, life cycle, market,
#: and prices, discounts and events of the target day.
ORIGIN_KEPT = (
    "origin_mean_7", "origin_mean_28", "origin_std_28", "origin_median_28", "lag_1", "lag_7", "app_mean_28", "web_mean_28", "demand", "demand_mean_7", "demand_mean_28", "demand_without_own", "n_available",
    "observed_days", "available_days", "days_since_available", "unavailable_streak", "origin_is_available_rate_28", "origin_stockout_rate_28", "share_28", "share_delta", "trend_7_28", "trend_14_28", "slope_7", "slope_28", "demand_7_28", "returned",
)
_AS_IS = ("origin_is_available_rate_28", "origin_stockout_rate_28", "share_28", "share_delta", "trend_7_28", "trend_14_28", "slope_7", "slope_28", "demand_7_28", "returned")
_EVENTS = (*[f"{n}_{kind}" for n in EVENTS for kind in ("days", "near")], *[f"{n}_window" for n in ("black_friday", "christmas", "new_year")])
WIDE = Inputs(
    numeric=(*NUMERIC, "season_364", "season_365", "season_371", "price", "discount_web", "discount_app", *[c for c in ORIGIN_KEPT if c not in _AS_IS]),
    plain=(*_AS_IS, "promo", "baseline_annual", *[n for n, _, _ in PRICE_RATIOS], *_EVENTS),
    domains=CATEGORICAL.domains,
)


def wide_panel(state: DataFrame, **more) -> DataFrame:
    """A direct panel with the origin's whole state and the target's price ratios: what WIDE reads."""
    return direct_panel(origin_state(state), keep=tuple(c for c in ORIGIN_KEPT), price=True, **more)


def features(panel: DataFrame, inputs: Inputs = SMALL) -> DataFrame:
    """log1p and plain numbers (x_) with flags of the missing ones, calendar categories, events, codes, label. Numbers that
    are not finite are missing; columns that the panel doesn't have too."""
    have = set(panel.columns)
    panel = panel.withColumns({k: v for k, v in events("target_date").items() if k in inputs.plain and k not in have})
    if "promo" in inputs.plain:
        panel = panel.withColumn("promo", F.col("is_promo").cast("double"))
    have = set(panel.columns)
    known = lambda c: finite(F.col(c).cast("double")) if c in have else F.lit(None).cast("double")
    numbers = {f"x_{c}": finite(F.log1p(known(c))) for c in inputs.numeric} | {f"x_{c}": known(c) for c in inputs.plain}
    out = panel.withColumns(numbers)
    return out.withColumns({f"missing_{c}": F.col(f"x_{c}").isNull().cast("double") for c in inputs.numbers} | {
        "horizon": F.col("horizon").cast("int"), "weekday": F.weekday("target_date"), "month": F.month("target_date"), "product_code": F.pmod("product_id", F.lit(PRODUCTS)).cast("int"),
        "label": F.log1p("target") - F.log1p("target_baseline"),
    })


def coded(df: DataFrame, domains) -> DataFrame:
    """df with d_<column>: the value's place in its fixed domain, any other value and null the place after the last. The
    column's ML attributes name all values, so every frame has the same codes and trees split on sets of them."""
    out = df
    for c, values in domains:
        own = (F.col(c) if c in df.columns else F.lit(None)).cast("int")
        place = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), own), F.lit(0))
        code = F.when(place > 0, place - 1).otherwise(len(values)).cast("double")
        out = out.withColumn(f"d_{c}", code.alias(f"d_{c}", metadata={"ml_attr": {"type": "nominal", "vals": [*map(str, values), "other"], "name": f"d_{c}"}}))
    return out


def seed_mean(predictions: list) -> dict:
    """pred: the mean over the finite predictions, at least 0 (null without any); the raw extremes; whether any was not finite."""
    a = F.array_compact(F.array(*[finite(p) for p in predictions]))
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    return {"pred": F.when(mean.isNotNull(), F.greatest(mean, F.lit(0.0))), "raw_min": F.array_min(a), "raw_max": F.array_max(a), "any_nonfinite": F.size(a) < len(predictions)}


def residual_bounds(panel: DataFrame, low: float = 0.001, high: float = 0.999, slack: float = 1.0) -> DataFrame:
    """One row: lower and upper bound of log residuals, from the training rows' quantiles, widened by slack."""
    rows = panel.select((F.log1p("target") - F.log1p("target_baseline")).alias("residual"))
    q = exact_quantiles(rows, "residual", {"low": low, "high": high})
    return q.select((F.col("low") - slack).alias("lower"), (F.col("high") + slack).alias("upper"))


@dataclass
class Preparation:
    """Fills and scales that were learned from training rows."""

    inputs: Inputs
    medians: dict[str, float]
    stages: PipelineModel

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows (with `features` taken) with the vector `features`."""
        return self.stages.transform(_filled(rows, self.inputs, self.medians))


def _filled(rows: DataFrame, inputs: Inputs, medians: dict[str, float]) -> DataFrame:
    out = coded(rows, inputs.domains).withColumns({f"f_{c}": F.coalesce(f"x_{c}", F.lit(medians[c])) for c in inputs.numbers})
    return out.withColumns({f"i_{c}": F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in inputs.ids if c in rows.columns})


def prepare(known: DataFrame, inputs: Inputs = SMALL, kind: str = "ridge") -> Preparation:
    """Medians of all numbers from one aggregation (0 where none is known), and the vector that suits the kind of model:
    trees get numbers and codes, a factor machine scaled numbers and hashed ids, the others scaled numbers and one-hot
    codes."""
    middle = known.agg(*[F.percentile_approx(f"x_{c}", 0.5, 10_000).alias(c) for c in inputs.numbers]).first()
    medians = {c: float(middle[c]) if middle[c] is not None else 0.0 for c in inputs.numbers}
    numbers, missing, codes = [f"f_{c}" for c in inputs.numbers], [f"missing_{c}" for c in inputs.numbers], [f"d_{c}" for c, _ in inputs.domains]
    scaled = [VectorAssembler(inputCols=numbers, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    if kind.startswith("trees"):
        stages = [VectorAssembler(inputCols=[*numbers, *missing, *codes], outputCol="features")]
    elif kind == "factor":
        ids = [f"i_{c}" for c in inputs.ids if c in known.columns]
        stages = [*scaled, FeatureHasher(inputCols=[*ids, "i_weekday", "i_month"], outputCol="hashed", numFeatures=HASHED), VectorAssembler(inputCols=["scaled", *missing, "hashed"], outputCol="features")]
        inputs = replace(inputs, ids=(*inputs.ids, "weekday", "month"))
    else:
        hot = [f"o_{c}" for c, _ in inputs.domains]
        stages = [*scaled, OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep"), VectorAssembler(inputCols=["scaled", *missing, *hot], outputCol="features")]
    return Preparation(inputs, medians, Pipeline(stages=stages).fit(_filled(known, inputs, medians)))


#: Weight of the ridge's penalty against the sum of squared errors.
ALPHA = 10.0


def ridge_penalty(train: DataFrame, alpha: float = ALPHA) -> float:
    """regParam that gives a ridge of `alpha` on the sum of weighted squared errors: the fit divides by the weights' sum and
    by the label's weighted deviation."""
    w, y = F.col("sample_weight"), F.col("label")
    r = train.agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy")).first()
    mean = r.wy / r.w
    return alpha / r.w * max(r.wyy / r.w - mean * mean, 0.0) ** 0.5


def regressor(kind: str, seed: int = 42, trees: int = 400, penalty: float = 0.01, bins: int = 32):
    """ridge, huber, factor (factorisation machine), trees_a (shallow), trees_b (fine), tweedie. bins: at least the values of
    the largest category that trees split on."""
    if kind == "ridge":
        return LinearRegression(elasticNetParam=0.0, regParam=penalty, standardization=False, solver="normal", weightCol="sample_weight")
    if kind == "factor":
        return FMRegressor(factorSize=12, maxIter=60, stepSize=0.02, regParam=0.001, seed=seed)
    if kind == "huber":
        return LinearRegression(loss="huber", weightCol="sample_weight")
    if kind == "trees_a":
        return GBTRegressor(maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=5, featureSubsetStrategy="0.8", maxBins=bins, weightCol="sample_weight", seed=seed)
    if kind == "trees_b":
        return GBTRegressor(maxIter=trees, maxDepth=7, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=10, featureSubsetStrategy="0.8", maxBins=bins, weightCol="sample_weight", seed=seed)
    if kind == "tweedie":
        return GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="target", weightCol="sample_weight", maxIter=50)
    raise ValueError(f"no such model: {kind}")


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """Rows repeated by a Poisson(weight) number from a hash of their key and the seed, for models that take no weights."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "product_id", "target_date", "horizon"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    w, below, times = F.col("sample_weight"), F.exp(-F.col("sample_weight")), F.lit(0)
    total = below
    for k in range(1, 9):
        times = times + (u > total).cast("int")
        below = below * w / k
        total = total + below
    return rows.withColumn("__times", times).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__times")))).where(F.col("__i") > 0).drop("__times", "__i")


def fit_share(train: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` with `share`, the app's share of the target: a logistic model of the smoothed share, weighted by volume."""
    share, known = app_share(F.col("target_app"), F.col("target"))
    own = features(train).withColumns({"share_label": share, "known": known, "volume": F.greatest("target", F.lit(0.0)) + 1e-6}).where("known")
    prepared = prepare(own)
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="share_label", weightCol="volume", predictionCol="share", regParam=0.01, maxIter=30).fit(prepared.transform(own))
    return model.transform(prepared.transform(features(rows))).select(*rows.columns, "share")


@dataclass
class Fitted:
    """A model of one kind, a fit for each seed, with its preparation and the bounds of its log residuals."""

    kind: str
    preparation: Preparation
    models: dict[int, object]
    lower: float
    upper: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` (a direct panel) with `pred`: the mean of the seeds' finite predictions, carried back, at least 0."""
        out = self.preparation.transform(features(rows, self.preparation.inputs))
        for seed, model in self.models.items():
            out = model.setPredictionCol(f"p_{seed}").transform(out)
        each = F.array_compact(F.array(*[finite(F.col(f"p_{s}")) for s in self.models]))
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(each), F.lit(0))
        held = F.least(F.greatest(mean, F.lit(self.lower)), F.lit(self.upper))
        back = mean if self.kind == "tweedie" else F.expm1(F.log1p("target_baseline") + held)
        return out.select(*rows.columns, F.greatest(back, F.lit(0.0)).alias("pred"))


def fit_model(train: DataFrame, kind: str, trees: int = 400, seeds: tuple[int, ...] = (42,), inputs: Inputs = SMALL) -> Fitted:
    """Learned from `train` (a direct panel with sample_weight), a fit a seed. The training rows stay in executors' memory
    and disk while fits pass over them. ValueError without any."""
    known = features(train, inputs).where("target is not null and target_baseline is not null and sample_weight is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lower, upper = residual_bounds(known).first()
        if lower is None:
            raise ValueError("no training rows")
        prepared = prepare(known, inputs, kind)
        ready = prepared.transform(known)
        penalty = ridge_penalty(ready) if kind == "ridge" else 0.0
        bins = max(32, *[len(v) + 1 for _, v in inputs.domains])
        fitted = {seed: regressor(kind, seed, trees, penalty, bins).fit(_drawn(ready, seed) if kind == "factor" else ready) for seed in seeds}
    finally:
        known.unpersist()
    return Fitted(kind, prepared, fitted, lower, upper)


def fit_predict(train: DataFrame, rows: DataFrame, kind: str, trees: int = 400, seeds: tuple[int, ...] = (42,), inputs: Inputs = SMALL) -> DataFrame:
    """`rows` (a direct panel) with `pred`, learned from `train`; seeds are averaged."""
    return fit_model(train, kind, trees, seeds, inputs).predict(rows)


def walk_forward(panel: DataFrame, origins: list[str], kind: str, half_life: float = 365.0, trees: int = 400, seeds: tuple[int, ...] = (42,), inputs: Inputs = SMALL) -> DataFrame:
    """Out-of-fold rows of every origin: fitted on the rows whose target was known by then, predicting the week after it.
    One fit an origin."""
    out = None
    for o in origins:
        train = recency_weights(trainable(panel, o), o, half_life)
        held = panel.where(F.col("origin") == F.lit(o).cast("date"))
        one = fit_predict(train, held, kind, trees, seeds, inputs).withColumnRenamed("target", "actual")
        out = one if out is None else out.unionByName(one)
    return out


def final_forecast(state: DataFrame, future: DataFrame, kind: str, half_life: float = 365.0, trees: int = 400, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """product_id, target_date, horizon, pred on the keys of `future`: fitted on all known rows, at each product's last day."""
    last = state.agg(F.max("date_key")).first()[0]
    train = recency_weights(trainable(direct_panel(state), str(last)), str(last), half_life)
    made = fit_predict(train, direct_panel(state, 7, future, at_last=True), kind, trees, seeds)
    return align(made.select("product_id", "target_date", "horizon", "pred"), future.select("product_id", F.col("date_key").alias("target_date")), ["product_id", "target_date"])
