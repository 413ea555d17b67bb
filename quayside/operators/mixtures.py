"""Weight plans over forecasts: searched by objective over candidates, by horizon or product, shrunk, applied and judged.

Every search is one pass over the rows, as matrix products of predictions and weights, to a row per scope, origin and
candidate, and all that follows works on that small table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles
from quayside.functions.scalar import stratum
from quayside.operators.blend import best, coefficients, fit
from quayside.operators.candidates import error_sums, named, weights_of


def merged(frames: dict[str, DataFrame], keys: list[str], value: str = "pred") -> DataFrame:
    """The members' predictions side by side (pred_<member>) on the keys that all have, by one shuffle: rows of all members
    together, then a pivot. ValueError if a member has a key twice."""
    parts = [df.select(*keys, F.lit(m).alias("member"), F.col(value).alias("value")) for m, df in frames.items()]
    every = reduce(DataFrame.unionByName, parts)
    twice = every.groupBy(*keys, "member").count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError("a member has a key twice")
    wide = every.groupBy(*keys).agg(F.count_distinct("member").alias("n"), *[F.max(F.when(F.col("member") == m, F.col("value"))).alias(f"pred_{m}") for m in frames])
    return wide.where(F.col("n") == len(frames)).drop("n")


def known(frame: DataFrame, members: list[str]) -> DataFrame:
    """Available rows with an actual and all members' predictions."""
    ok = reduce(lambda a, b: a & b, [F.col(f"pred_{m}").isNotNull() for m in members], F.coalesce("available", F.lit(False)) & F.col("actual").isNotNull())
    return frame.where(ok)


def drawn_candidates(spark: SparkSession, members: list[str], draws: int, seed: int = 42) -> DataFrame:
    """candidate, w_<member>: each member alone, all evenly, for two members a line of 101 points, and Dirichlet(1.3) draws."""
    n = len(members)
    rows = [*np.eye(n).tolist(), [1 / n] * n]
    if n == 2:
        rows += [[1 - i / 100, i / 100] for i in range(101)]
    rows += np.random.default_rng(seed).dirichlet(np.full(n, 1.3), size=draws).tolist()
    return spark.createDataFrame([(f"{i:06d}", *map(float, r)) for i, r in enumerate(rows)], "candidate string, " + ", ".join(f"w_{m} double" for m in members))


def _blend(members: list[str], prefix: str = "w_") -> Column:
    total = sum((F.col(f"pred_{m}") * F.col(f"{prefix}{m}") for m in members[1:]), F.col(f"pred_{members[0]}") * F.col(f"{prefix}{members[0]}"))
    return F.greatest(total, F.lit(0.0))


def search(frame: DataFrame, members: list[str], candidates: DataFrame, reference: str, scope: tuple[str, ...] = (), stability: float = 0.06, bias: float = 0.03) -> DataFrame:
    """Per scope the candidate of least objective: WAPE + stability x deviation of the origins' improvements over the
    reference + bias x |bias ratio| (ties: the first by name), with its weights and measures and the scope's rows."""
    names, weights = weights_of(candidates, members)
    sums = error_sums(known(frame, members), [f"pred_{m}" for m in members], weights, [*scope, "origin"], f"pred_{reference}")
    gain = F.when(F.col("v") > 0, F.when(F.col("r") > 0, (F.col("r") - F.col("e")) / F.col("r")).otherwise(0.0))
    out = sums.groupBy(*scope, "candidate").agg(
        F.sum("n").cast("long").alias("n"), (F.sum("e") / F.sum("v")).alias("wape"), (F.sum("b") / F.sum("v")).alias("bias_ratio"), (1 - F.sum("e") / F.nullif(F.sum("r"), F.lit(0.0))).alias("improvement"),
        F.coalesce(F.stddev_pop(gain), F.lit(1.0)).alias("spread"), F.coalesce(F.avg(F.when(gain.isNotNull(), (gain > 0).cast("double"))), F.lit(0.0)).alias("won"), F.sum("v").alias("volume"),
    ).where("volume > 0")
    out = named(out, names, weights, members)
    out = out.withColumn("objective", F.col("wape") + stability * F.col("spread") + bias * F.abs("bias_ratio"))
    out = out.withColumn("one", F.lit(0))
    place = F.row_number().over(Window.partitionBy(*(scope or ("one",))).orderBy(F.round("objective", 12), "candidate"))
    won = out.withColumn("place", place).where("place = 1")
    weight = [f"w_{m}" for m in members]
    return won.select("candidate", *scope, *[c for c in won.columns if c not in ("candidate", "place", "volume", "one", *scope, *weight)], *weight)


def shrunk(local: DataFrame, overall: DataFrame, members: list[str], prior: float, most: float = 1.0) -> DataFrame:
    """The scopes' weights drawn to the overall ones by n / (n + prior), at most `most`, and scaled to sum to 1."""
    base = overall.select(*[F.col(f"w_{m}").alias(f"all_{m}") for m in members])
    k = F.least(F.lit(most), F.col("n") / (F.col("n") + prior))
    mixed = {m: k * F.col(f"w_{m}") + (1 - k) * F.col(f"all_{m}") for m in members}
    total = sum((mixed[m] for m in members[1:]), mixed[members[0]])
    return local.crossJoin(F.broadcast(base)).withColumns({f"w_{m}": mixed[m] / total for m in members}).drop(*[f"all_{m}" for m in members])  # one row


def horizon_plan(frame: DataFrame, members: list[str], candidates: DataFrame, reference: str, prior: float = 500.0) -> DataFrame:
    """horizon, n, w_<member>."""
    local = search(frame, members, candidates, reference, ("horizon",), stability=0.0, bias=0.01)
    return shrunk(local, search(frame, members, candidates, reference), members, prior).select("horizon", "n", *[f"w_{m}" for m in members])


def product_plan(frame: DataFrame, members: list[str], candidates: DataFrame, reference: str, prior: float = 180.0) -> DataFrame:
    """product_id, n, w_<member>: at most three quarters of a product's weights are its own."""
    local = search(frame, members, candidates, reference, ("product_id",), stability=0.02, bias=0.02)
    return shrunk(local, search(frame, members, candidates, reference), members, prior, 0.75).select("product_id", "n", *[f"w_{m}" for m in members])


def apply_plan(frame: DataFrame, members: list[str], overall: DataFrame, local: DataFrame | None = None, key: str | None = None, scales: DataFrame | None = None, name: str = "blend") -> DataFrame:
    """frame with the plan's forecast, at least 0; null unless all members are known.

    overall: one row of weights. local: weights by `key` (horizon or product_id), where there are none the overall ones.
    scales: horizon, scale to multiply by (1 where there is none).
    """
    base = overall.select(*[F.col(f"w_{m}").alias(f"all_{m}") for m in members])
    rows = frame.crossJoin(F.broadcast(base))  # one row
    if local is not None:
        rows = rows.join(local.select(key, *[F.col(f"w_{m}").alias(f"own_{m}") for m in members]), key, "left")
        rows = rows.withColumns({f"all_{m}": F.coalesce(f"own_{m}", f"all_{m}") for m in members}).drop(*[f"own_{m}" for m in members])
    total = sum((F.col(f"pred_{m}") * F.col(f"all_{m}") for m in members[1:]), F.col(f"pred_{members[0]}") * F.col(f"all_{members[0]}"))
    rows = rows.withColumn(name, total).drop(*[f"all_{m}" for m in members])
    if scales is not None:
        rows = rows.join(scales.select("horizon", "scale"), "horizon", "left").withColumn(name, F.col(name) * F.coalesce("scale", F.lit(1.0))).drop("scale")
    return rows.withColumn(name, F.when(F.col(name).isNotNull(), F.greatest(F.col(name), F.lit(0.0))))


def evaluation(frame: DataFrame, pred: str, reference: str) -> DataFrame:
    """One row: WAPE, bias ratio, improvement over the reference, and the same for the top tenth of actuals."""
    rows = frame.where(F.coalesce("available", F.lit(False)) & F.col("actual").isNotNull() & F.col(pred).isNotNull() & F.col(reference).isNotNull())
    rows = rows.crossJoin(F.broadcast(exact_quantiles(rows, "actual", {"cut": 0.9})))  # one row
    top = F.col("actual") >= F.col("cut")
    e = lambda c: F.abs(F.col(c) - F.col("actual"))
    v, tv = F.nullif(F.sum(F.abs("actual")), F.lit(0.0)), F.nullif(F.sum(F.when(top, F.abs("actual"))), F.lit(0.0))
    out = rows.agg(
        F.count("*").alias("n"), (F.sum(e(pred)) / v).alias("wape"), (F.sum(F.col(pred) - F.col("actual")) / v).alias("bias_ratio"), (F.sum(e(reference)) / v).alias("reference_wape"),
        (F.sum(F.when(top, e(pred))) / tv).alias("top_wape"), (F.sum(F.when(top, e(reference))) / tv).alias("reference_top_wape"),
    )
    return out.withColumns({"improvement": (F.col("reference_wape") - F.col("wape")) / F.nullif("reference_wape", F.lit(0.0)), "top_change": (F.col("top_wape") - F.col("reference_top_wape")) / F.nullif("reference_top_wape", F.lit(0.0))})


def by_stratum(frame: DataFrame, pred: str, reference: str) -> DataFrame:
    """stratum, wape, reference_wape and the relative change."""
    rows = frame.where(F.coalesce("available", F.lit(False)) & F.col("actual").isNotNull() & F.col(pred).isNotNull() & F.col(reference).isNotNull()).withColumn("stratum", stratum(F.col("origin")))
    v = F.nullif(F.sum(F.abs("actual")), F.lit(0.0))
    w = lambda c: F.sum(F.abs(F.col(c) - F.col("actual"))) / v
    out = rows.groupBy("stratum").agg(w(pred).alias("wape"), w(reference).alias("reference_wape"))
    return out.withColumn("change", (F.col("wape") - F.col("reference_wape")) / F.nullif("reference_wape", F.lit(0.0)))


def gates(evidence: DataFrame, least: float = 0.002, top: float = 0.02, holiday: float = 0.03, sure: float = 0.75) -> DataFrame:
    """Which candidates pass every gate, and their score. evidence: candidate, improvement, top_change, holiday_change (null:
    no holiday), p_positive."""
    change = F.coalesce("holiday_change", F.lit(0.0))
    each = {
        "passes_development": F.col("improvement") >= least, "passes_top": F.col("top_change") <= top, "passes_holiday": change <= holiday, "passes_bootstrap": F.col("p_positive") >= sure,
        "score": F.col("improvement") - 0.10 * F.greatest("top_change", F.lit(0.0)) - 0.10 * F.greatest(change, F.lit(0.0)),
    }
    out = evidence.withColumns(each)
    return out.withColumn("accepted", F.coalesce(F.col("passes_development") & F.col("passes_top") & F.col("passes_holiday") & F.col("passes_bootstrap"), F.lit(False)))


def winner(gated: DataFrame) -> DataFrame:
    """The accepted candidate of largest score (ties: by name), or one row 'control'."""
    best_ = gated.where("accepted").orderBy(F.desc(F.round("score", 12)), "candidate").limit(1).select("candidate", "score", F.lit(0).alias("o"))
    none = gated.sparkSession.range(1).select(F.lit("control").alias("candidate"), F.lit(0.0).alias("score"), F.lit(1).alias("o"))
    return best_.unionByName(none).orderBy("o").limit(1).drop("o")


def fit_and_confirm(development: DataFrame, benchmark: DataFrame, members: list[str], steps: int = 10, least: float = 0.002, regression: float = 0.02) -> DataFrame:
    """One row: the convex blend fitted on the development rows, the best single member there, both on the benchmark rows,
    and whether the blend is accepted. The benchmark never moves a weight."""
    scored = fit(development, members, steps)
    blend = best(scored).select("candidate", *[f"w_{m}" for m in members], F.col("aligned").alias("development_aligned"), F.col("broad").alias("development_broad"))
    alone = F.coalesce(*[F.when(F.col(f"w_{m}") == 1.0, F.lit(m)) for m in members])
    place = F.coalesce(*[F.when(F.col("best_single") == m, F.lit(i)) for i, m in enumerate(members)])
    single = scored.withColumn("best_single", alone).where("best_single is not null").orderBy(F.round("aligned", 12), place).limit(1).select("best_single", F.col("aligned").alias("single_development_aligned"))
    plan = blend.crossJoin(F.broadcast(single))  # one row
    rows = coefficients(known(benchmark, members)).crossJoin(F.broadcast(plan))  # one row
    own = F.coalesce(*[F.when(F.col("best_single") == m, F.col(f"pred_{m}")) for m in members])
    held = rows.agg(F.sum(F.col("coef") * F.abs(_blend(members) - F.col("actual"))).alias("benchmark_aligned"), F.sum(F.col("coef") * F.abs(own - F.col("actual"))).alias("single_benchmark_aligned"), F.count("*").alias("n_benchmark"))
    out = plan.crossJoin(F.broadcast(held))  # one row
    gain = (F.col("single_development_aligned") - F.col("development_aligned")) / F.nullif("single_development_aligned", F.lit(0.0))
    change = (F.col("benchmark_aligned") - F.col("single_benchmark_aligned")) / F.nullif("single_benchmark_aligned", F.lit(0.0))
    out = out.withColumns({"improvement": F.coalesce(gain, F.lit(0.0)), "benchmark_change": change})
    return out.withColumns({"confirmed": F.coalesce(F.col("benchmark_change") <= regression, F.lit(False)), "accepted": F.coalesce((F.col("improvement") >= least) & (F.col("benchmark_change") <= regression), F.lit(False))})


def meta_features(frame: DataFrame, members: list[str]) -> DataFrame:
    """Members' mean, sample deviation and range, differences to the first, plain and relative, and the date's cycle."""
    a = F.array(*[F.col(f"pred_{m}") for m in members])
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(members)
    square = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    first = F.col(f"pred_{members[0]}")
    turn = lambda c, n: c.cast("double") * (2 * np.pi / n)
    month, weekday = turn(F.month("target_date"), 12), turn(F.weekday("target_date"), 7)
    return frame.withColumns({
        "member_mean": mean, "member_std": F.coalesce(F.sqrt(square / (len(members) - 1)) if len(members) > 1 else F.lit(0.0), F.lit(0.0)), "member_range": F.array_max(a) - F.array_min(a),
        "month_sin": F.sin(month), "month_cos": F.cos(month), "weekday_sin": F.sin(weekday), "weekday_cos": F.cos(weekday),
        **{f"delta_{m}": F.col(f"pred_{m}") - first for m in members[1:]}, **{f"relative_delta_{m}": (F.col(f"pred_{m}") - first) / (F.abs(first) + 1) for m in members[1:]},
    })


def gate_blend(control: Column, specialist: Column, advantage: Column, scale: Column, most: float = 0.75) -> Column:
    """The control moved to the specialist by most x (advantage / scale, within 0 and 1); at least 0."""
    alpha = most * F.greatest(F.lit(0.0), F.least(F.lit(1.0), advantage / F.greatest(scale, F.lit(1e-6))))
    return F.greatest(control + alpha * (specialist - control), F.lit(0.0))


def advantage_scale(frame: DataFrame, control: str, specialist: str) -> DataFrame:
    """One row: the upper quartile of the specialist's positive advantages in absolute error, at least 1 (without any, of
    all advantages' sizes)."""
    gain = F.abs(F.col("actual") - F.col(control)) - F.abs(F.col("actual") - F.col(specialist))
    rows = frame.select(gain.alias("gain")).where("gain is not null")
    up = exact_quantiles(rows.where("gain > 0"), "gain", {"up": 0.75})
    every = exact_quantiles(rows.select(F.abs("gain").alias("gain")), "gain", {"every": 0.75})
    return up.crossJoin(F.broadcast(every)).select(F.greatest(F.coalesce("up", "every"), F.lit(1.0)).alias("scale"))  # one row


def weighted_lags(state: DataFrame, weight: str = "weight") -> Column:
    """The same-weekday baseline with each day's own weight on top: 4, 3, 2, 1 times the weight of that day."""
    from quayside.operators.windows import days

    num, den = F.lit(0.0), F.lit(0.0)
    for k in (1, 2, 3, 4):
        q, w = F.lag("qty_available", 7 * k).over(days()), F.coalesce(F.lag(weight, 7 * k).over(days()), F.lit(1.0))
        num, den = num + F.coalesce(q * w * (5 - k), F.lit(0.0)), den + F.when(q.isNotNull(), w * (5 - k)).otherwise(0.0)
    return F.when(den > 0, num / den)


def residual_panel(state: DataFrame, prof: DataFrame, horizons: int = 7, skip: int = 35) -> DataFrame:
    """A compact panel for residual models: the origin's state, the target's baseline weighted by anomaly, and the anomaly
    state of the origin; the first `skip` days of a product are left out. Target rows find their origin by date."""
    from quayside.operators.anomaly import ORIGIN_COLUMNS
    from quayside.operators.windows import days

    rows = state.join(prof.select("product_id", "date_key", "weight", *[F.col(c).alias(f"origin_{c}") for c in ORIGIN_COLUMNS]), ["product_id", "date_key"], "left")
    rows = rows.withColumns({"day": F.row_number().over(days()), "weighted_baseline": weighted_lags(rows), "mean_7": F.avg("qty_available").over(days().rowsBetween(-6, 0)), "mean_28": F.avg("qty_available").over(days().rowsBetween(-27, 0))})
    origin = rows.select("product_id", F.col("date_key").alias("origin"), F.col("qty_available").alias("lag_0"), "mean_7", "mean_28", *[f"origin_{c}" for c in ORIGIN_COLUMNS])
    target = rows.where(F.col("day") > skip).select("product_id", F.col("date_key").alias("target_date"), F.col("quantity").alias("target"), "available", "weighted_baseline", "price", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon"))
    return target.withColumn("origin", F.date_sub("target_date", F.col("horizon"))).join(origin, ["product_id", "origin"], "left")
