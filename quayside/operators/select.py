"""Choices between candidates by their scores, and the evidence for them. Candidates are few; their scores come from
one aggregation over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_totals(oof: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Per origin: the volume, both predictions' absolute errors, over rows where both can be scored."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (reference, candidate, "actual")]) & F.col("available")
    err = lambda c: F.sum(F.abs(F.col(c) - F.col("actual")))
    return oof.where(known).groupBy("origin").agg(F.sum(F.abs("actual")).alias("volume"), err(reference).alias("ref"), err(candidate).alias("cand"))


def bootstrap(totals: DataFrame, draws: int = 500) -> DataFrame:
    """Relative improvement over `draws` resamples of whole origins, drawn by md5 of draw and place (the same on every
    run): mean, 2.5 and 97.5 % bounds, and the share above zero."""
    numbered = totals.withColumns({"one": F.lit(0)}).withColumn("at", F.row_number().over(Window.partitionBy("one").orderBy("origin")) - 1)
    n = numbered.agg(F.count("*").alias("n"))
    picks = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).where("n > 0").select("draw", "n", F.explode(F.sequence(F.lit(1), "n")).alias("place"))
    word = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.col("place").cast("string"))), 1, 8), 16, 10).cast("long")
    each = picks.withColumn("at", (word % F.col("n")).cast("int")).join(F.broadcast(numbered), "at").groupBy("draw").agg((1 - F.sum("cand") / F.nullif(F.sum("ref"), F.lit(0.0))).alias("gain"))
    q = F.percentile("gain", F.array(F.lit(0.025), F.lit(0.975)))
    return each.agg(F.avg("gain").alias("mean"), q.alias("q"), F.avg((F.col("gain") > 0).cast("double")).alias("p_positive")).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "p_positive")


def ranking(long: DataFrame, reference: str) -> DataFrame:
    """Models by improvement + .05 x share of origins won - .12 x deviation of the origins' improvements."""
    each = long.where("common").groupBy("model", "origin").agg(F.sum(F.abs(F.col("pred") - F.col("actual"))).alias("e"))
    ref = each.where(F.col("model") == reference).select("origin", F.col("e").alias("r"))
    gain = 1 - F.col("e") / F.nullif("r", F.lit(0.0))
    out = each.join(ref, "origin").withColumn("gain", gain).groupBy("model").agg((1 - F.sum("e") / F.sum("r")).alias("improvement"), F.avg((F.col("gain") > 0).cast("double")).alias("won"), F.stddev_pop("gain").alias("spread"))
    return out.withColumn("score", F.col("improvement") + 0.05 * F.col("won") - 0.12 * F.col("spread"))


def screened(scores: DataFrame, control: Column, least: float = 0.002, slack: float = 1.03) -> DataFrame:
    """Candidates (candidate, aligned, broad) whose broad score is within `slack` of the control's: the one of least
    aligned score, or the control unless that is `least` better."""
    base = scores.where(control).select(F.col("aligned").alias("control_aligned"), F.col("broad").alias("control_broad"), F.lit(True).alias("found")).limit(1)
    rows = scores.crossJoin(F.broadcast(base)).where(F.col("broad") <= slack * F.col("control_broad"))
    better = F.col("aligned") <= (1 - least) * F.col("control_aligned")
    return rows.where(better | control).orderBy(F.when(better, 0).otherwise(1), F.round("aligned", 12), "candidate").limit(1).drop("found")


def shrunk_plan(local: DataFrame, overall: DataFrame, members: list[str], prior: float = 500.0) -> DataFrame:
    """Each group's best weights drawn towards the overall ones by n / (n + prior). `local`: n and w_<member> by group."""
    base = overall.select(*[F.col(f"w_{m}").alias(f"all_{m}") for m in members]).limit(1)
    k = F.col("n") / (F.col("n") + prior)
    return local.crossJoin(F.broadcast(base)).withColumns({f"w_{m}": k * F.col(f"w_{m}") + (1 - k) * F.col(f"all_{m}") for m in members}).drop(*[f"all_{m}" for m in members])


def primary(summary: DataFrame) -> DataFrame:
    """The rows that decide: available days, common population, all folds together."""
    return summary.where("regime = 'conditional' and population = 'common' and aggregation = 'global'")


def best_strategy(rows: DataFrame, metric: str = "wape") -> DataFrame:
    """Of each model, the strategy of least metric (ties: by name), and `rank`: its place among the models."""
    key = F.struct(F.round(metric, 9).alias("m"), "strategy")
    won = rows.where(F.col(metric).isNotNull()).groupBy("model").agg(F.min_by("strategy", key).alias("strategy"), F.min(metric).alias(metric)).withColumn("one", F.lit(0))
    return won.withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy(F.round(metric, 9), "model"))).drop("one")


def family_top(scores: DataFrame, k: int, control: Column) -> DataFrame:
    """Candidates (candidate, family, aligned): the control, the best k, and the best of each family."""
    order = [F.round("aligned", 12), F.col("candidate")]
    rows = scores.withColumn("one", F.lit(0)).withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy(*order)))
    rows = rows.withColumn("in_family", F.row_number().over(Window.partitionBy("family").orderBy(*order)))
    return rows.where(control | (F.col("rank") <= k) | (F.col("in_family") == 1)).drop("one")


def cheapest_within(runs: DataFrame, quality: str, cost: str, tolerance: float = 0.02) -> DataFrame:
    """The run of least cost whose quality is within the tolerance of the best."""
    best = runs.agg(F.min(quality).alias("__best"))
    fits = runs.crossJoin(F.broadcast(best)).where(F.col(quality) <= F.col("__best") * (1 + tolerance))
    return fits.orderBy(cost, F.round(quality, 12), "candidate").limit(1).drop("__best")


def policy_sweep(scored: DataFrame, policies: dict[str, Column], actual: str, pred: str) -> DataFrame:
    """All weighting policies in one pass: mean weight, rows weighted down, weighted WAPE. `policies`: name to weight."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), w.alias("weight")) for n, w in policies.items()])).alias("p")
    rows = scored.select(F.col(actual).alias("a"), F.col(pred).alias("b"), each).select("a", "b", "p.policy", "p.weight")
    err, vol = F.sum(F.col("weight") * F.abs(F.col("a") - F.col("b"))), F.sum(F.when(F.col("b").isNotNull(), F.col("weight") * F.abs("a")))
    return rows.groupBy("policy").agg(F.count("*").alias("n"), F.avg("weight").alias("mean_weight"), F.count_if(F.col("weight") < 1).alias("weighted_down"), (err / F.nullif(vol, F.lit(0.0))).alias("wape"))


def check_plan(plan: DataFrame, members: list[str]) -> DataFrame:
    """Long weights (scope, member, weight), by scope: total, least, active members, unknown members, and whether it is valid."""
    out = plan.groupBy("scope").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.count_if(F.col("weight") > 1e-8).alias("active"), F.count_if(~F.col("member").isin(members)).alias("unknown"))
    return out.withColumn("valid", F.coalesce((F.abs(F.col("total") - 1) < 1e-6) & (F.col("least") >= 0) & (F.col("unknown") == 0), F.lit(False)))


def even_origins(days: DataFrame, k: int) -> DataFrame:
    """k dates spread evenly over the distinct ones, ends included (all, if fewer)."""
    rows = days.select("date_key").distinct().withColumn("one", F.lit(0))
    numbered = rows.select("date_key", (F.row_number().over(Window.partitionBy("one").orderBy("date_key")) - 1).alias("at"), F.count("*").over(Window.partitionBy("one")).alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((i * (F.col("n") - 1) + (k - 1) / 2) / F.lit(max(k - 1, 1))).cast("int"))
    return numbered.where(F.array_contains(places, F.col("at")) | (F.col("n") <= k)).select("date_key")


def recent_origins(days: DataFrame, k: int, apart: int = 7) -> DataFrame:
    """The last k origins whose target weeks do not meet and end by the last day."""
    last = days.agg(F.max("date_key").alias("last"))
    return last.where("last is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.date_sub(F.col("last"), i * apart))).alias("origin"))


def keep_first(rows: DataFrame, same: list[str], order: str) -> DataFrame:
    """Of rows that agree on `same`, the first by `order`."""
    place = F.row_number().over(Window.partitionBy(*same).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def unused(every: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `every` that `used` doesn't have."""
    return every.join(used.select(*on).distinct(), on, "left_anti")


def side_by_side(control: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """keys, actual, control, candidate of the keys that both have."""
    a, b = control.withColumnRenamed("pred", "control"), candidate.withColumnRenamed("pred", "candidate")
    return a.join(b, keys).select(*keys, "actual", "control", "candidate")


def seed_pairs(daily: DataFrame) -> DataFrame:
    """date_key, seed_a, seed_b, score_a, score_b of all pairs of seeds on the days that both have (date_key, seed, score)."""
    rows = daily.where("score is not null")
    a = rows.select("date_key", F.col("seed").alias("seed_a"), F.col("score").alias("score_a"))
    b = rows.select("date_key", F.col("seed").alias("seed_b"), F.col("score").alias("score_b"))
    return a.join(b, "date_key").where("seed_a < seed_b")


#: Columns of the showcase of screening tables.
SHOWCASE = ("wape", "test_aligned_wape", "bias_ratio", "coverage")


def showcase(tables: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """tier, stage, candidate, model, the measures, description, selected, place: screening tables in one schema.

    tables: tier, table (candidate, and whatever it has of stage, model, description and the measures), and the names of the
    candidates that were chosen. What a table lacks is null (stage: the tier). In order: tier, stage, chosen ones first, then
    by test-aligned WAPE, unknown ones last. The tables have a row per candidate.
    """
    parts = []
    for tier, df, chosen in tables:
        own = lambda c, kind, otherwise=None: F.col(c).cast(kind) if c in df.columns else F.lit(otherwise).cast(kind)  # noqa: E731,B023
        selected = F.col("candidate").cast("string").isin(chosen) if chosen else F.lit(False)
        parts.append(df.select(F.lit(tier).alias("tier"), own("stage", "string", tier).alias("stage"), own("candidate", "string").alias("candidate"), own("model", "string").alias("model"), *[own(m, "double").alias(m) for m in SHOWCASE], own("description", "string", "").alias("description"), selected.alias("selected")))
    out = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("one").orderBy("tier", "stage", F.desc("selected"), F.round("test_aligned_wape", 9).asc_nulls_last(), "candidate")
    return out.withColumn("one", F.lit(0)).withColumn("place", F.row_number().over(order)).drop("one")


def evidence_violations(stated: DataFrame, derived: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """candidate, measure, stated, derived, violation: figures that a stored table states (candidate, measure, value) against
    those derived anew: 'differs' beyond the tolerance, 'not derived' and 'not stated'. None: no rows."""
    a = stated.select("candidate", "measure", F.col("value").cast("double").alias("stated"), F.lit(True).alias("is_stated"))
    b = derived.select("candidate", "measure", F.col("value").cast("double").alias("derived"), F.lit(True).alias("is_derived"))
    both = a.join(b, ["candidate", "measure"], "full")
    off = F.abs(F.col("stated") - F.col("derived")) > tolerance
    kind = F.when(F.col("is_derived").isNull(), "not derived").when(F.col("is_stated").isNull(), "not stated").when(off | (F.col("stated").isNull() != F.col("derived").isNull()), "differs")
    return both.select("candidate", "measure", "stated", "derived", kind.alias("violation")).where("violation is not null")


def gated(scores: DataFrame, control: Column, least: float = 0.002, slack: float = 1.03, coverage: float = 0.999, regression: float = 0.02) -> DataFrame:
    """scores (candidate, aligned, broad, coverage, benchmark) with each gate and `place` among those that pass: the aligned
    score is `least` better than the control's, the broad one within `slack` of it, enough rows are scored, and the benchmark
    is no more than `regression` worse. The control passes its own gates; the best place is the choice. No control: none
    passes."""
    base = scores.where(control).agg(*[F.min(c).alias(f"control_{c}") for c in ("aligned", "broad", "benchmark")])  # one row
    own = F.coalesce(control, F.lit(False))
    gates = {
        "passes_score": own | (F.col("aligned") <= (1 - least) * F.col("control_aligned")), "passes_broad": F.col("broad") <= slack * F.col("control_broad"),
        "passes_coverage": F.col("coverage") >= coverage, "passes_benchmark": F.col("benchmark") <= (1 + regression) * F.col("control_benchmark"),
    }
    rows = scores.crossJoin(F.broadcast(base)).withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    passes = reduce(lambda a, b: a & b, [F.col(k) for k in gates])
    rows = rows.withColumns({"passes": passes, "one": F.lit(0)})
    place = F.row_number().over(Window.partitionBy("one").orderBy(F.desc("passes"), F.when(own, 1).otherwise(0), F.round("aligned", 12), "candidate"))
    return rows.withColumn("place", F.when(F.col("passes"), place)).drop("one", "control_aligned", "control_broad", "control_benchmark")
