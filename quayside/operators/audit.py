"""Daily scores by split: thresholds and weights from calibration days, evidence on holdout days, and integrity checks.

The daily tables have a row per day; `__all` stands in for their partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.anomaly import daily_window
from quayside.operators.context import split_of
from quayside.operators.windows import baseline_with_fallback

SPLITS = ("train", "validation", "calibration", "holdout")


def daily_scores(scored: DataFrame, ends: tuple[str, str, str]) -> DataFrame:
    """date_key, score (0.9 quantile of the products' scores), any_event, split."""
    day = scored.groupBy("date_key").agg(F.percentile("score", F.lit(0.9)).alias("score"), F.bool_or("known_event").alias("any_event"))
    return day.withColumn("split", split_of(F.col("date_key"), *ends))


def holdout_state(daily: DataFrame, alpha: float = 0.02, strength: float = 1.0, event_floor: float = 0.65) -> DataFrame:
    """Flag, weight, trailing means and flag rate of every day; null off the holdout split, where scores were fitted."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.75), F.lit(1 - alpha)))
    stats = daily.where("split = 'calibration'").agg(q.alias("q")).select(F.get("q", F.lit(2)).alias("threshold"), F.greatest((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.349, F.lit(1e-6)).alias("scale"))
    out = daily.crossJoin(F.broadcast(stats)).withColumn("__all", F.lit(0)).withColumn("flag", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))
    down = F.exp(-strength * F.greatest((F.col("score") - F.col("threshold")) / F.col("scale"), F.lit(0.0)))
    recent = lambda n: daily_window().rowsBetween(-(n - 1), 0)
    out = out.withColumns({
        "weight": F.coalesce(F.when(F.col("any_event"), F.greatest(down, F.lit(event_floor))).otherwise(down), F.lit(1.0)),
        "mean_7": F.avg("score").over(recent(7)),
        "mean_28": F.avg("score").over(recent(28)),
        "flag_rate_28": F.avg(F.col("flag").cast("double")).over(recent(28)),
    })
    held = F.col("split") == "holdout"
    return out.withColumns({c: F.when(held, F.col(c)) for c in ("flag", "weight", "mean_7", "mean_28", "flag_rate_28")}).drop("__all", "threshold", "scale")


def difficulty(state: DataFrame, ahead: int = 7) -> DataFrame:
    """Per day: the weighted baseline's WAPE over the next days, all products together."""
    rows = state.withColumn("base", baseline_with_fallback())
    day = rows.groupBy("date_key").agg(F.sum(F.abs(F.col("qty_available") - F.col("base"))).alias("e"), F.sum(F.abs("qty_available")).alias("v")).withColumn("__all", F.lit(0))
    w = daily_window().rowsBetween(1, ahead)
    return day.select("date_key", (F.sum("e").over(w) / F.nullif(F.sum("v").over(w), F.lit(0.0))).alias("difficulty"))


def mean_rank(column: str) -> Column:
    """Rank among known values, ties sharing their mean rank."""
    known = Window.partitionBy(F.col(column).isNull())
    return F.rank().over(known.orderBy(column)) + (F.count(F.lit(1)).over(known.partitionBy(F.col(column).isNull(), column)) - 1) / 2


def diagnostics(daily: DataFrame, hard: DataFrame) -> DataFrame:
    """One row over days with score and difficulty: rank correlation, lag-1 autocorrelation of the score, mean
    difficulty of the top score decile over the mean of all, share of event days."""
    rows = daily.join(hard, "date_key").where("score is not null and difficulty is not null").withColumns({"score": F.round("score", 9), "difficulty": F.round("difficulty", 9), "__all": F.lit(0)})
    rows = rows.withColumns({"rs": mean_rank("score"), "rd": mean_rank("difficulty"), "before": F.lag("score").over(daily_window())})
    top = rows.agg(F.percentile("score", F.lit(0.9)).alias("top"))
    return rows.crossJoin(F.broadcast(top)).agg(
        F.count("*").alias("n"), F.corr("rs", "rd").alias("rank_correlation"), F.corr("score", "before").alias("autocorrelation"),
        (F.avg(F.when(F.col("score") >= F.col("top"), F.col("difficulty"))) / F.avg("difficulty")).alias("top_lift"), F.avg(F.col("any_event").cast("double")).alias("event_share"),
    )


def integrity(daily: DataFrame) -> DataFrame:
    """One row of violation counts: null dates, repeated dates, scores that are negative or not finite, splits out of order."""
    place = F.coalesce(*[F.when(F.col("split") == s, F.lit(i)) for i, s in enumerate(SPLITS)])
    rows = daily.withColumns({"__all": F.lit(0), "place": place})
    w = daily_window()
    rows = rows.withColumns({"again": F.col("date_key") == F.lag("date_key").over(w), "back": F.col("place") < F.lag("place").over(w)})
    bad = F.col("score").isNotNull() & ((F.col("score") < 0) | F.isnan("score") | (F.col("score") == float("inf")))
    return rows.agg(F.count("*").alias("n_days"), *[F.count_if(c).alias(n) for n, c in (("null_dates", F.col("date_key").isNull()), ("repeated_dates", F.col("again")), ("bad_scores", bad), ("splits_back", F.col("back")))])


def context_rarity(rows: DataFrame, columns: list[str], scale: DataFrame) -> DataFrame:
    """rows with `rarity`: mean distance of the columns from their median in robust scales (`scale`: feature, median, scale)."""
    flat = scale.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "scale")))).alias("by"))  # one entry a column
    part = [F.abs(F.col(c) - F.col("by")[c]["median"]) / F.col("by")[c]["scale"] for c in columns]
    return rows.crossJoin(F.broadcast(flat)).withColumn("rarity", sum((F.coalesce(p, F.lit(0.0)) for p in part[1:]), F.coalesce(part[0], F.lit(0.0))) / len(columns)).drop("by")


def risk_rollup(ranked: DataFrame, flagged: float = 0.99) -> DataFrame:
    """Per day: mean and largest risk percentile, and how many rows are flagged."""
    return ranked.groupBy("date_key").agg(F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), F.count_if(F.col("risk") >= flagged).alias("flagged"))


def seeded(scored: DataFrame, seeds: int = 3, keep: int = 3, of: int = 4) -> DataFrame:
    """scored (product_id, ...) once for each seed, with the products that the seed draws: about `keep` of `of`, by md5."""
    rows = scored.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    word = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("seed").cast("string"), F.col("product_id").cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.where(word % of < keep)


def seed_scores(scored: DataFrame, ends: tuple[str, str, str], seeds: int = 3) -> DataFrame:
    """seed, date_key, score (0.9 quantile of the drawn products' scores), any_event, split: one detector a seed."""
    day = seeded(scored, seeds).groupBy("seed", "date_key").agg(F.percentile("score", F.lit(0.9)).alias("score"), F.bool_or("known_event").alias("any_event"))
    return day.withColumn("split", split_of(F.col("date_key"), *ends))


def spearman(rows: DataFrame, by: list[str], a: str, b: str, name: str) -> DataFrame:
    """by..., name: rank correlation of a and b (ties share their mean rank) over rows with both; 0 without spread. Values are
    compared to nine places."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"__a": F.round(F.col(a).cast("double"), 9), "__b": F.round(F.col(b).cast("double"), 9)})
    place = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    ranks = known.withColumns({"__ra": place("__a"), "__rb": place("__b")})
    r = F.corr("__ra", "__rb")
    return ranks.groupBy(*by).agg(F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias(name))


def run_metrics(daily: DataFrame, hard: DataFrame, alpha: float = 0.02) -> DataFrame:
    """Per seed: how far the flag rates of calibration and holdout days are from alpha (a day is flagged above the calibration
    scores' 1 - alpha quantile), and on holdout days the score's drift with time, its correlation with the day before, its
    rank correlation with the difficulty to come, the lift of the top score tenth (1 under 20 days), and event enrichment."""
    cut = daily.where("split = 'calibration'").groupBy("seed").agg(F.percentile("score", F.lit(1 - alpha)).alias("threshold"))
    rows = daily.join(cut, "seed").withColumn("flag", (F.col("score") > F.col("threshold")).cast("double"))
    rate = lambda c: F.avg(F.when(c, F.col("flag")))
    held = F.col("split") == "holdout"
    rates = rows.groupBy("seed").agg(
        F.abs(rate(F.col("split") == "calibration") - alpha).alias("calibration_far_error"), F.abs(rate(held) - alpha).alias("holdout_far_error"),
        ((F.coalesce(rate(held & F.col("any_event")), F.lit(0.0)) + 1e-4) / (F.coalesce(rate(held & ~F.col("any_event")), F.lit(0.0)) + 1e-4)).alias("event_enrichment"),
    )
    holdout = rows.where(held & F.col("score").isNotNull()).withColumn("day", F.datediff("date_key", F.lit("1970-01-01").cast("date")))
    before = holdout.withColumn("before", F.lag("score").over(Window.partitionBy("seed").orderBy("date_key")))
    again = F.corr("score", "before")
    lag = before.groupBy("seed").agg(F.coalesce(F.when((F.count("*") > 3) & ~F.isnan(again), again), F.lit(0.0)).alias("persistence"))
    both = holdout.join(hard, "date_key").where("difficulty is not null")
    top = both.groupBy("seed").agg(F.percentile("score", F.lit(0.9)).alias("top"), F.count("*").alias("n"), F.avg("difficulty").alias("usual"))
    lifted = both.join(top, "seed").groupBy("seed").agg(F.first("n").alias("n_holdout"), (F.avg(F.when(F.col("score") >= F.col("top"), F.col("difficulty"))) / F.nullif(F.first("usual"), F.lit(0.0))).alias("lift"))
    lifted = lifted.select("seed", "n_holdout", F.when(F.col("n_holdout") >= 20, F.coalesce("lift", F.lit(1.0))).otherwise(1.0).alias("top_lift"))
    out = rates.join(spearman(holdout, ["seed"], "day", "score", "drift"), "seed", "left").join(lag, "seed", "left")
    out = out.join(spearman(both, ["seed"], "score", "difficulty", "predictive"), "seed", "left").join(lifted, "seed", "left")
    return out.fillna(0.0, ["drift", "persistence", "predictive"]).fillna(1.0, ["top_lift"])


def diagnostic_objective(metrics: DataFrame, daily: DataFrame) -> DataFrame:
    """One row from the seeds' metrics (run_metrics) and scores: each component and the objective. What a detector foresees
    counts .45, the tanh of its lift beyond 1 counts .20, the mean rank agreement of all pairs of seeds .25 (1 with a single
    seed); far-off flag rates, drift and persistence beyond .85 are taken off."""
    a = daily.where("score is not null").select("date_key", F.col("seed").alias("seed_a"), F.col("score").alias("score_a"))
    b = daily.where("score is not null").select("date_key", F.col("seed").alias("seed_b"), F.col("score").alias("score_b"))
    pairs = spearman(a.join(b, "date_key").where("seed_a < seed_b"), ["seed_a", "seed_b"], "score_a", "score_b", "agreement")
    stable = pairs.agg(F.coalesce(F.avg("agreement"), F.lit(1.0)).alias("seed_stability"), F.count("*").alias("n_pairs"))
    mean = metrics.agg(F.count("*").alias("n_seeds"), *[F.avg(c).alias(c) for c in ("predictive", "top_lift", "calibration_far_error", "holdout_far_error", "drift", "persistence")])
    out = mean.crossJoin(F.broadcast(stable))  # one row each
    zero = F.lit(0.0)
    parts = {
        "predictive_component": F.greatest(F.lit(-0.25), F.col("predictive")), "lift_component": F.tanh(F.greatest(zero, F.col("top_lift") - 1)),
        "calibration_penalty": 4.0 * (F.col("calibration_far_error") + F.col("holdout_far_error")), "drift_penalty": 0.30 * F.abs("drift"),
        "persistence_penalty": 0.20 * F.greatest(zero, F.col("persistence") - 0.85),
    }
    out = out.withColumns(parts)
    total = 0.45 * F.col("predictive_component") + 0.20 * F.col("lift_component") + 0.25 * F.col("seed_stability") - F.col("calibration_penalty") - F.col("drift_penalty") - F.col("persistence_penalty")
    return out.select("n_seeds", "n_pairs", *parts, "seed_stability", total.alias("objective"))
