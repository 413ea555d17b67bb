"""Recursive forecasts: each step's prediction is part of the next step's history.

`forecast` takes a step that is an expression over a product's last days: these travel as one bounded array, all steps
are one expression over it, and any number of products and origins is a single shuffle. `forecast_with` takes any
function from a one-step panel to predictions (a fitted model, say) and runs a bounded number of rounds, one a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalar import finite, safe_log_ratio, weighted_present
from quayside.operators.windows import channel_history, days
from quayside.plans.direct import direct_panel
from quayside.sources.panel import sanitize_future
from quayside.sources.shared import written

#: A step's value above both is thrown out: a fixed limit, and a multiple of the largest value that was ever observed.
LIMIT, TIMES = 10_000.0, 50.0
#: Days of history that a one-step panel looks back on.
BACK = 400


def mean_step(width: int = 28) -> Callable[[Column], Column]:
    """The mean of the last days that are known."""

    def step(history: Column) -> Column:
        known = F.filter(F.slice(history, F.greatest(F.size(history) - (width - 1), F.lit(1)), width), lambda x: x.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))

    return step


def growth_step(history: Column) -> Column:
    """The last value, grown as it has over the last week; null where a week ago nothing is known or was sold."""
    last = _ago(history, 1)
    return last * last / F.nullif(_ago(history, 8), F.lit(0.0))


def _ago(history: Column, d: int) -> Column:
    """The value d days before the day after the history's last."""
    return F.get(history, F.size(history) - d)


def _median_7(history: Column) -> Column:
    known = F.array_sort(F.filter(F.slice(history, F.greatest(F.size(history) - 6, F.lit(1)), 7), lambda x: x.isNotNull()))
    n = F.size(known)
    return F.when(n > 0, (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2)


def baseline_of(history: Column) -> Column:
    """The next day's weighted same-weekday baseline; else the last 7 days' median; else 0."""
    same = weighted_present([(_ago(history, 7 * k), 5 - k) for k in (1, 2, 3, 4)])
    return F.coalesce(same, _median_7(history), F.lit(0.0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def histories(state: DataFrame, origins: list[str], width: int = 28) -> DataFrame:
    """product_id, origin, history (at most width days up to the origin, oldest first; unavailable days null) and top, the
    largest quantity observed up to the origin. Products without a row on the origin's day have no forecast there."""
    at = F.filter(F.array(*[F.lit(o).cast("date") for o in origins]), lambda o: F.col("date_key").between(F.date_sub(o, width - 1), o))
    past = days().rowsBetween(Window.unboundedPreceding, 0)
    rows = state.select("product_id", "date_key", F.col("qty_available").cast("double").alias("q"), F.max(finite(F.col("quantity").cast("double"))).over(past).alias("top"), at.alias("at"))
    rows = rows.select("product_id", "date_key", "q", "top", F.explode("at").alias("origin"))
    own = F.sort_array(F.collect_list(F.struct("date_key", "q")))
    out = rows.groupBy("product_id", "origin").agg(own.alias("days"), F.max("date_key").alias("last"), F.max("top").alias("top"))
    return out.where("last = origin").select("product_id", "origin", F.transform("days", lambda d: d["q"]).alias("history"), "top")


def safety_limit(top: Column, baseline: Column) -> Column:
    """From the observed past and the baseline only, so that generated values never widen it."""
    zero = F.lit(0.0)
    return F.greatest(F.lit(LIMIT), TIMES * F.greatest(F.coalesce(finite(top), zero), F.coalesce(finite(baseline), zero), F.lit(1.0)))


def guarded(pred: Column, baseline: Column, last: Column, limit: Column) -> dict[str, Column]:
    """A step's value and its guards: not finite or beyond the limit, it becomes the baseline, else the last day's value,
    else 0; none is negative."""
    bad, wild = finite(pred).isNull(), F.coalesce(finite(pred) > limit, F.lit(False))
    instead = F.coalesce(F.when(finite(baseline) >= 0, baseline), F.when(finite(last) >= 0, last), F.lit(0.0))
    return {"pred": F.greatest(F.when(bad | wild, instead).otherwise(pred), F.lit(0.0)), "fallback_used": bad | wild, "nonfinite": bad, "catastrophic": wild, "safety_limit": limit}


def bounded(pred: Column, baseline: Column, bounds: tuple[float, float]) -> dict[str, Column]:
    """A step's value with its log residual over the baseline kept within the bounds that the training residuals support,
    whether that changed it, and the residual as it was."""
    residual = finite(safe_log_ratio(pred, baseline))
    low, high = (F.lit(float(b)) for b in bounds)
    out = F.coalesce((residual < low) | (residual > high), F.lit(False))
    kept = F.expm1(F.log1p(baseline) + F.greatest(low, F.least(high, residual)))
    return {"pred": F.when(out, kept).otherwise(pred), "residual_guard": out, "residual_nonfinite": residual.isNull(), "residual": residual}


def forecast(state: DataFrame, origins: list[str], step: Callable[[Column], Column] | None = None, horizons: int = 7, bounds: tuple[float, float] | None = None) -> DataFrame:
    """product_id, origin, horizon, target_date, pred and the guards (`guarded`) of every step; with bounds also those of
    `bounded`, which come first."""
    step = step or mean_step()
    kind = "struct<pred:double,fallback_used:boolean,nonfinite:boolean,catastrophic:boolean,safety_limit:double"
    kind += ",residual_guard:boolean,residual_nonfinite:boolean,residual:double>" if bounds else ">"

    def guards(x: Column) -> Column:
        kept = bounded(x["step"], x["base"], bounds) if bounds else {"pred": x["step"]}
        made = guarded(kept.pop("pred"), x["base"], x["last"], safety_limit(F.col("top"), x["base"]))
        return F.struct(*[v.alias(k) for k, v in {**made, **kept}.items()]).cast(kind)

    def grow(acc: Column, _: Column) -> Column:
        h = acc["h"]
        made = _once(F.struct(step(h).cast("double").alias("step"), baseline_of(h).alias("base"), F.element_at(h, -1).alias("last")), guards)
        return _once(made, lambda m: F.struct(F.concat(h, F.array(m["pred"])).alias("h"), F.concat(acc["out"], F.array(m)).alias("out")))

    start = F.struct(F.col("history").alias("h"), F.array().cast(f"array<{kind}>").alias("out"))
    rows = histories(state, origins).withColumn("made", F.aggregate(F.sequence(F.lit(1), F.lit(horizons)), start, grow)["out"])
    out = rows.select("product_id", "origin", F.posexplode("made").alias("pos", "x"))
    return out.select("product_id", "origin", (F.col("pos") + 1).alias("horizon"), F.date_add("origin", F.col("pos") + 1).alias("target_date"), "x.*")


def step_panel(state: DataFrame, future: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per product: the day after its last one, from the covariates known ahead; horizon 1."""
    return direct_panel(state, 1, future, keep=keep, at_last=True)


def forecast_with(state: DataFrame, future: DataFrame, predict: Callable[[DataFrame], DataFrame], horizons: int = 7, top: DataFrame | None = None) -> DataFrame:
    """The days of `future` (product_id, date_key and the covariates known ahead), one after another, for every product
    whose history ends the day before the first: product_id, origin, horizon, target_date, pred, the guards, app_share.

    predict: a one-step panel to the same rows with `pred` and, if the model has one, `app_share`. A step's value is
    the next step's history, available, and split on the channels by the model's share, else the last 28 days', else
    the last day's, else all app. `horizons` rounds; a round's rows are written, so no plan grows over the days. top:
    product_id, __top, the largest quantity ever observed, where `state` does not go back that far.
    """
    ahead = written(sanitize_future(future))
    end = state.groupBy("product_id").agg(F.max("date_key").alias("first_origin"), F.max(finite(F.col("quantity").cast("double"))).alias("top"))
    if top is not None:
        end = end.join(top, "product_id", "left").withColumn("top", F.greatest("top", finite(F.col("__top").cast("double")))).drop("__top")
    end = written(end)
    recent = written(state.join(end.drop("top"), "product_id").where(F.datediff("first_origin", "date_key") < BACK).drop("first_origin"))
    history, parts = recent, []
    share = channel_history()
    for h in range(1, horizons + 1):
        here = ahead.join(end.drop("top"), "product_id").where(F.datediff("date_key", "first_origin") == h).drop("first_origin")
        own = history.withColumns({"own_share_28": share["share_28"], "own_share_0": share["share_lag_0"]})
        panel = step_panel(own, here, ("own_share_28", "own_share_0"))
        made = predict(panel)
        app = F.when(finite(F.col("app_share")).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("app_share")))) if "app_share" in made.columns else F.lit(None).cast("double")
        made = made.withColumn("__app", app).join(end, "product_id")
        limit = safety_limit(F.col("top"), F.col("target_baseline"))
        guards = guarded(F.col("pred").cast("double"), F.col("target_baseline"), F.col("lag_0"), limit)
        step = written(made.select("product_id", "first_origin", "target_date", *[v.alias(k) for k, v in guards.items()], F.col("__app").alias("app_share"), F.coalesce("__app", "own_share_28", "own_share_0").alias("__split")))
        parts.append(step.select("product_id", F.col("first_origin").alias("origin"), F.lit(h).alias("horizon"), "target_date", *guards, "app_share"))
        new = here.join(step.select("product_id", F.col("target_date").alias("date_key"), F.col("pred").alias("quantity"), "__split"), ["product_id", "date_key"])
        split = F.coalesce("__split", F.lit(1.0))
        new = new.withColumns({
            "available": F.lit(True), "is_gap": F.lit(False), "observed": F.lit(1), "is_available": F.lit(1), "is_unavailable": F.lit(0), "qty_available": F.col("quantity"),
            "quantity_app": F.col("quantity") * split, "quantity_web": F.col("quantity") * (1 - split),
        }).drop("__split")
        history = history.unionByName(new, allowMissingColumns=True)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_actuals(predictions: DataFrame, state: DataFrame) -> DataFrame:
    """Predictions beside what came true; days past a product's end have no row."""
    actual = state.select("product_id", F.col("date_key").alias("target_date"), F.col("quantity").alias("actual"), "available")
    return predictions.join(actual, ["product_id", "target_date"])


def stability(paired: DataFrame) -> DataFrame:
    """Per origin: WAPE, the largest prediction and its ratio to the largest actual, guarded steps, and whether the
    recursion is sane."""
    ok = F.col("available") & F.col("actual").isNotNull()
    e, v = F.sum(F.when(ok, F.abs(F.col("pred") - F.col("actual")))), F.sum(F.when(ok, F.abs("actual")))
    out = paired.groupBy("origin").agg(
        (e / F.nullif(v, F.lit(0.0))).alias("wape"), F.max("pred").alias("largest"), (F.max("pred") / F.greatest(F.max("actual"), F.lit(1.0))).alias("ratio"),
        F.count_if("fallback_used").alias("fallbacks"), F.count_if("catastrophic").alias("beyond_limit"), F.count_if("nonfinite").alias("nonfinite"),
    )
    return out.withColumn("passes", F.coalesce((F.col("largest") <= 5000) & (F.col("ratio") <= 20) & (F.col("wape") < 2), F.lit(False)))


#: Measures that two strategies are compared by.
MEASURES = ("mae", "rmse", "wape", "smape", "bias")


def compare(direct: DataFrame, recursive: DataFrame) -> DataFrame:
    """Per model and measure, over the rows that both strategies have (product_id, origin, horizon, model, actual,
    available, pred each): both values, the difference and the better one (of bias: nearer to zero)."""
    keys = ["product_id", "origin", "horizon", "model"]
    both = direct.select(*keys, "actual", "available", F.col("pred").alias("d")).join(recursive.select(*keys, F.col("pred").alias("r")), keys).where("available and actual is not null and d is not null and r is not null")
    y, volume = F.col("actual"), F.sum(F.abs("actual"))

    def of(c: str) -> list[Column]:
        e = F.col(c) - y
        made = (F.avg(F.abs(e)), F.sqrt(F.avg(e * e)), F.sum(F.abs(e)) / F.nullif(volume, F.lit(0.0)), F.avg(2 * F.abs(e) / (F.abs(y) + F.abs(c) + 1e-8)), F.avg(e))
        return [f.alias(f"{c}_{m}") for m, f in zip(MEASURES, made)]

    row = both.groupBy("model").agg(*of("d"), *of("r"))
    long = row.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"d_{m}").alias("direct"), F.col(f"r_{m}").alias("recursive")) for m in MEASURES])).alias("x")).select("model", "x.*")
    return long.withColumns({"delta": F.col("recursive") - F.col("direct"), "winner": F.when(F.abs("direct") <= F.abs("recursive"), "direct").otherwise("recursive")})
