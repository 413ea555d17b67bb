"""Thresholds from the tail of a score: peaks over a cut-off, a generalised Pareto fit, checked on later scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles, ranked
from quayside.sources.shared import written

#: Points of a grid of one round of the fit, and rounds.
GRID, ROUNDS = 48, 4


def gpd_quantile(alpha: Column, u: Column, xi: Column, beta: Column, pu: Column) -> Column:
    """The value that a share alpha of all exceeds, where a share pu exceeds u; u itself for alpha >= pu."""
    tail = alpha / pu
    heavy = u + beta / xi * (F.pow(tail, -xi) - 1)
    return F.when(alpha >= pu, u).when(F.abs(xi) < 1e-7, u - beta * F.log(tail)).otherwise(heavy)


def gpd_cdf(x: Column, xi: Column, beta: Column) -> Column:
    """Share of exceedances at or under x >= 0."""
    inner = F.greatest(1 + xi * x / beta, F.lit(0.0))
    return F.when(F.abs(xi) < 1e-7, 1 - F.exp(-x / beta)).when(inner <= 0, F.lit(1.0)).otherwise(1 - F.pow(inner, -1 / xi))


def in_time_order(scored: DataFrame, column: str) -> DataFrame:
    """date_key, v, position (from 0, by day, then product) of the known non-negative finite scores. Positions come from
    counts per day, so only a day's rows are sorted together."""
    names = [c for c in ("product_id",) if c in scored.columns]
    rows = scored.select("date_key", *names, F.col(column).cast("double").alias("v")).where((F.col("v") >= 0) & (F.col("v") < float("inf")))
    days = rows.groupBy("date_key").agg(F.count("*").alias("k")).withColumn("one", F.lit(0))
    before = days.select("date_key", (F.sum("k").over(Window.partitionBy("one").orderBy("date_key")) - F.col("k")).alias("before"))  # a row a day
    own = F.row_number().over(Window.partitionBy("date_key").orderBy(*names, "v")) - 1
    return rows.withColumn("own", own).join(before, "date_key").select("date_key", "v", (F.col("own") + F.col("before")).alias("position"))


def gpd_fits(exceedances: DataFrame) -> DataFrame:
    """cut, n_exceed, xi, beta by maximum likelihood of every cut's exceedances (cut, e > 0), all cuts at once.

    Of the ratio t = xi / beta the likelihood's best xi is the mean of log(1 + t e), which leaves one number to search: a
    grid of it is scored in one aggregation, then a finer grid around the best, a bounded number of rounds.
    """
    spark = exceedances.sparkSession
    base = {r.cut: r for r in exceedances.groupBy("cut").agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.max("e").alias("most")).collect()}  # a row a cut
    span = {c: (-0.999 / r.most, 20.0 / r.mean) for c, r in base.items()}
    best = {c: (-r.n * (math.log(r.mean) + 1), 0.0, r.mean) for c, r in base.items()}  # xi = 0
    for turn in range(ROUNDS):
        grids = {}
        for c, (a, z) in span.items():
            if turn:
                grids[c] = [a + (z - a) * i / (GRID - 1) for i in range(GRID)]
            else:  # half the points below zero, half above, denser near it
                half = GRID // 2
                grids[c] = [a * (1 - i / half) ** 2 for i in range(half)] + [z * (i / half) ** 2 for i in range(1, half + 1)]
        points = spark.createDataFrame([(c, [float(t) for t in g]) for c, g in grids.items()], "cut int, ts array<double>")
        met = exceedances.join(F.broadcast(points), "cut")  # a row a cut
        sums = met.groupBy("cut").agg(*[F.sum(F.log1p(F.get("ts", F.lit(i)) * F.col("e"))).alias(f"s{i}") for i in range(GRID)])
        for r in sums.collect():
            scored = []
            for i, t in enumerate(grids[r.cut]):
                xi = (r[f"s{i}"] or 0.0) / base[r.cut].n
                if t and xi / t > 0:
                    beta = xi / t
                    scored.append((-base[r.cut].n * (math.log(beta) + xi + 1), xi, beta, i))
            if scored:
                top = max(scored)
                best[r.cut] = max(best[r.cut], top[:3])
                g, i = grids[r.cut], top[3]
                span[r.cut] = (g[max(i - 1, 0)], g[min(i + 1, GRID - 1)])
    return spark.createDataFrame([(c, base[c].n, xi, beta) for c, (_, xi, beta) in best.items()], "cut int, n_exceed long, xi double, beta double")


def tail_threshold(scored: DataFrame, column: str = "score", alpha: float = 0.01, tail_quantile: float = 0.90, least: int = 30, validation: float = 0.20) -> DataFrame:
    """One row: threshold, method, alpha, tail_quantile, u, xi, beta, n_total, n_exceed, validation_rate, validation_error, ks.

    The first 80 % of the scores in time give seven cut-offs and a fit above each; a fit counts if it is stable. The one
    whose threshold later scores exceed nearest to alpha, with a tenth of the Kolmogorov-Smirnov distance added, is
    taken. Too few scores, or no stable fit: the empirical quantile. No scores: an infinite threshold.
    """
    if not 0 < alpha < 1 or not 0.5 <= tail_quantile < 1:
        raise ValueError("alpha: between 0 and 1; tail_quantile: from 0.5 to under 1")
    spark = scored.sparkSession
    rows = written(in_time_order(scored, column))
    n = rows.count()
    schema = "threshold double, method string, alpha double, tail_quantile double, u double, xi double, beta double, n_total long, n_exceed long, validation_rate double, validation_error double, ks double"
    if not n:
        return spark.createDataFrame([(float("inf"), "no_scores", alpha, tail_quantile, None, None, None, 0, None, None, None, None)], schema)
    plain = exact_quantiles(rows, "v", {"t": 1 - alpha}).first().t
    instead = lambda method: spark.createDataFrame([(plain, method, alpha, tail_quantile, None, None, None, n, None, None, None, None)], schema)
    if n < max(2 * least, 100):
        return instead("empirical_quantile_small_sample")
    split = min(max(round(n * (1 - validation)), 2 * least), n - least)
    low, high = max(0.80, tail_quantile - 0.05), min(0.98, tail_quantile + 0.06)
    shares = sorted({round(low + (high - low) * i / 6, 4) for i in range(7)})
    fit, later = rows.where(F.col("position") < split), rows.where(F.col("position") >= split)
    order, n_fit = ranked(fit, "v")
    us = exact_quantiles(fit, "v", {f"q{i}": q for i, q in enumerate(shares)}).first()
    most = fit.agg(F.max("v")).first()[0]
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(us[f"q{i}"]).alias("u")) for i in range(len(shares))])
    above = order.where(F.col("v") > us["q0"]).withColumn("c", F.explode(F.filter(cuts, lambda c: c["u"] < F.col("v"))))
    above = written(above.select("c.cut", "c.u", (F.col("v") - F.col("c.u")).alias("e"), "rank"))
    fits = gpd_fits(above).where(F.col("n_exceed") >= least)
    u_of = F.element_at(F.array(*[F.lit(us[f"q{i}"]) for i in range(len(shares))]), F.col("cut") + 1)
    pu = F.col("n_exceed") / F.lit(n_fit)
    fits = fits.withColumn("u", u_of).withColumn("threshold", gpd_quantile(F.lit(alpha), F.col("u"), F.col("xi"), F.col("beta"), pu))
    kept = [r for r in fits.collect() if r.beta > 0 and math.isfinite(r.threshold) and r.u <= r.threshold <= max(5 * most, r.u + 20)]  # at most seven rows
    if not kept:
        return instead("empirical_quantile_fallback")
    own = spark.createDataFrame([(r.cut, r.n_exceed, r.xi, r.beta) for r in kept], "cut int, n_exceed long, xi double, beta double")
    place = F.col("rank") - (F.lit(n_fit) - F.col("n_exceed"))
    cdf = gpd_cdf(F.col("e"), F.col("xi"), F.col("beta"))
    off = F.greatest((place + 1) / F.col("n_exceed") - cdf, cdf - place / F.col("n_exceed"))
    ks = {r.cut: r.ks for r in above.join(F.broadcast(own), "cut").groupBy("cut").agg(F.max(off).alias("ks")).collect()}
    rates = later.agg(*[F.avg((F.col("v") > r.threshold).cast("double")).alias(f"r{r.cut}") for r in kept]).first()
    error = {r.cut: abs(rates[f"r{r.cut}"] - alpha) for r in kept}
    won = min(kept, key=lambda r: (error[r.cut] + 0.10 * ks[r.cut], r.cut))
    return spark.createDataFrame([(won.threshold, "evt_pot_gpd", alpha, shares[won.cut], won.u, won.xi, won.beta, n_fit, won.n_exceed, rates[f"r{won.cut}"], error[won.cut], ks[won.cut])], schema)
