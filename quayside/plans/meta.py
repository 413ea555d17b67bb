"""Models on top of forecasts: a ridge on the residuals of a reference, and gates that learn where a specialist is better.
Every row is predicted by a fit that has not seen its origin.

The ridge needs one pass: sums of products by origin. A fold's fit is the total less its own sums, solved as a small
matrix on the driver (columns squared, a matrix an origin).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles
from quayside.operators.mixtures import gate_blend, known, meta_features
from quayside.sources.shared import written

#: Columns that stand for products: one each, as long as there are no more products than that.
PRODUCTS, HORIZONS = 32, 7
CYCLES = ("month_sin", "month_cos", "weekday_sin", "weekday_cos")


def prepared(frame: DataFrame, members: list[str], extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The known rows with a meta-model's features, and their names: members, their mean, deviation, range and differences,
    the date's cycles, horizon and product by number and by indicator, and `extra` columns. Nulls and infinities become
    the column's median over all rows, with an indicator beside it."""
    rows = meta_features(known(frame, members), members)
    one = lambda c: c.cast("double")
    rows = rows.withColumns({f"horizon_is_{h}": one(F.col("horizon") == h) for h in range(1, HORIZONS + 1)} | {f"product_is_{k}": one(F.pmod("product_id", F.lit(PRODUCTS)) == k) for k in range(PRODUCTS)})
    names = [f"pred_{m}" for m in members] + ["member_mean", "member_std", "member_range", *CYCLES, "horizon"]
    names += [f"{kind}_{m}" for m in members[1:] for kind in ("delta", "relative_delta")]
    names += [f"horizon_is_{h}" for h in range(1, HORIZONS + 1)] + [f"product_is_{k}" for k in range(PRODUCTS)]
    for c in extra:
        v = F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
        rows = rows.withColumn(f"x_{c}", v)
    for c in extra:  # one row each
        middle = exact_quantiles(rows, f"x_{c}", {"m": 0.5}).first().m
        rows = rows.withColumns({f"missing_{c}": F.col(f"x_{c}").isNull().cast("double"), f"x_{c}": F.coalesce(f"x_{c}", F.lit(float(middle or 0.0)))})
        names += [f"x_{c}", f"missing_{c}"]
    return written(rows.withColumns({c: F.col(c).cast("double") for c in names if c != "horizon"}).withColumn("x_horizon", F.col("horizon").cast("double"))), ["x_horizon" if c == "horizon" else c for c in names]


def gram(rows: DataFrame, columns: list[str], by: str, weight: str | None = None) -> DataFrame:
    """by, i, j, total: the sums of column_i x column_j, i <= j; column 0 is 1. A task adds up its own batches first, so
    what is shuffled has a row for each task, group and pair of columns."""
    p = len(columns) + 1
    upper = np.triu_indices(p)
    kind = rows.schema[by].dataType.simpleString()

    def run(batches):
        held: dict = {}
        kept = None
        for b in batches:
            kept = b.schema.field(by).type
            x = np.column_stack([np.ones(b.num_rows), *[np.asarray(b.column(c), float) for c in columns]])
            w = np.asarray(b.column(weight), float)[:, None] if weight else 1.0
            keys = b.column(by).to_pylist()
            number: dict = {}
            at = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
            for k, i in number.items():
                own = x[at == i]
                held[k] = held.get(k, 0) + (own * (w[at == i] if weight else 1.0)).T @ own
        for k, g in held.items():
            n = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, kept), pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(g[upper])], names=[by, "i", "j", "total"])

    needed = list(dict.fromkeys([by, *columns, *([weight] if weight else [])]))
    return rows.select(*needed).mapInArrow(run, f"`{by}` {kind}, i int, j int, total double").groupBy(by, "i", "j").agg(F.sum("total").alias("total"))


def matrices(sums: DataFrame, by: str, p: int) -> dict:
    """The groups' matrices: p x p each, as many as there are groups (origins)."""
    out: dict = {}
    for r in sums.toArrow().to_pylist():
        g = out.setdefault(r[by], np.zeros((p, p)))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["total"]
    return out


def ridge(g: np.ndarray, alpha: float, use: list[int] | None = None) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the ridge on standardised columns from sums of products: column 0 is 1, the last one
    the label. use: columns (from 1) that take part, the rest have coefficient 0."""
    n, p = g[0, 0], len(g) - 2
    use = list(range(1, p + 1)) if use is None else use
    mean = g[0] / n
    c = g - n * np.outer(mean, mean)
    out = np.zeros(p)
    if use:
        sd = np.sqrt(np.maximum(np.diag(c)[use] / n, 0.0))
        sd = np.where(sd > 1e-9 * np.maximum(np.abs(mean[use]), 1.0), sd, 1.0)
        a = c[np.ix_(use, use)] / np.outer(sd, sd) + alpha * np.eye(len(use))
        out[np.array(use) - 1] = np.linalg.solve(a, c[use, -1] / sd) / sd
    return float(mean[-1] - out @ mean[1:-1]), out


def _with_correction(rows: DataFrame, names: list[str], fits: dict, by: str) -> DataFrame:
    """rows with `correction`: the linear prediction of their group's fit (a row a group)."""
    kind = rows.schema[by].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(k, float(a), [float(x) for x in c]) for k, (a, c) in fits.items()], f"`{by}` {kind}, __a double, __c array<double>")
    total = F.col("__a")
    for i, c in enumerate(names):
        total = total + F.get("__c", F.lit(i)) * F.col(c)
    return rows.join(F.broadcast(table), by).withColumn("correction", total).drop("__a", "__c")  # a row an origin


def stacked(frame: DataFrame, members: list[str], reference: str, alpha: float = 100.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """The known rows with `stacked`: the reference moved by a ridge on its residual, fitted without the row's origin; at
    least 0. With a single origin, which leaves nothing to learn from, the reference as it is."""
    rows, names = prepared(frame, members, extra)
    rows = rows.withColumn("__label", F.col("actual") - F.col(f"pred_{reference}"))
    # around the overall means, so that sums of squares keep their digits
    centre = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    moved = rows.withColumns({f"__{c}": F.col(c) - F.lit(float(centre[c] or 0.0)) for c in names})
    columns = [*[f"__{c}" for c in names], "__label"]
    own = matrices(gram(moved, columns, "origin"), "origin", len(columns) + 1)
    total = sum(own.values(), np.zeros((len(columns) + 1,) * 2))
    nothing = (0.0, np.zeros(len(names)))
    fits = {o: ridge(total - g, alpha) if total[0, 0] - g[0, 0] > 0.5 else nothing for o, g in own.items()}
    out = _with_correction(moved, columns[:-1], fits, "origin")
    return out.withColumn("stacked", F.greatest(F.col(f"pred_{reference}") + F.col("correction"), F.lit(0.0))).select(*frame.columns, "stacked")


def _boosted(rows: DataFrame, names: list[str], label: str, trees: int, step: float, depth: int, leaf: int, seed: int):
    """Boosted trees for the absolute error."""
    vector = VectorAssembler(inputCols=names, outputCol="__x")
    model = GBTRegressor(lossType="absolute", labelCol=label, featuresCol="__x", predictionCol="__p", maxIter=trees, stepSize=step, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    fitted = model.fit(vector.transform(rows))
    return lambda other: fitted.transform(vector.transform(other)).drop("__x")


def crossfit(rows: DataFrame, names: list[str], label: str, trees: int, step: float, depth: int, leaf: int, seed: int = 42) -> DataFrame:
    """rows (written, with `origin`) with `__p`: the label predicted by boosted trees that did not see the row's origin.
    A fit an origin; with a single origin 0."""
    origins = sorted(r.origin for r in rows.select("origin").distinct().collect())
    out = None
    for i, o in enumerate(origins):
        here = rows.where(F.col("origin") == F.lit(o))
        made = _boosted(rows.where(F.col("origin") != F.lit(o)), names, label, trees, step, depth, leaf, seed + i)(here) if len(origins) > 1 else here.withColumn("__p", F.lit(0.0))
        out = made if out is None else out.unionByName(made)
    return rows.withColumn("__p", F.lit(0.0)) if out is None else out


def risk_gate(frame: DataFrame, members: list[str], reference: str, trees: int = 180, step: float = 0.04, extra: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """The known rows with `gated`: the reference moved by what boosted trees make of its residual, by absolute error and
    without the row's origin; at least 0."""
    rows, names = prepared(frame, members, extra)
    rows = rows.withColumn("__label", F.col("actual") - F.col(f"pred_{reference}"))
    out = crossfit(rows, names, "__label", trees, step, 3, 35, seed)
    return out.withColumn("gated", F.greatest(F.col(f"pred_{reference}") + F.col("__p"), F.lit(0.0))).select(*frame.columns, "gated")


def advantage(control: str, specialist: str) -> Column:
    """By how much less the specialist is off."""
    return F.abs(F.col("actual") - F.col(f"pred_{control}")) - F.abs(F.col("actual") - F.col(f"pred_{specialist}"))


def fold_scales(rows: DataFrame, gain: str) -> DataFrame:
    """origin, scale: the upper quartile of positive gains at all other origins (without any: of all gains' sizes), at
    least 1. A quantile an origin."""
    origins = sorted(r.origin for r in rows.select("origin").distinct().collect())
    out = []
    for o in origins:
        other = rows.where(F.col("origin") != F.lit(o))
        q = exact_quantiles(other.where(F.col(gain) > 0), gain, {"q": 0.75}).first().q
        if q is None:
            q = exact_quantiles(other.select(F.abs(gain).alias("size")), "size", {"q": 0.75}).first().q
        out.append((o, max(float(q or 0.0), 1.0)))
    return rows.sparkSession.createDataFrame(out, f"origin {rows.schema['origin'].dataType.simpleString()}, scale double")


def specialist_gate(frame: DataFrame, control: str, specialist: str, most: float = 0.75, trees: int = 220, step: float = 0.04, extra: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """The known rows with predicted_advantage (of the specialist over the control, learned from the other origins), scale
    (theirs), alpha (most x advantage / scale, within 0 and most) and the blend: only a positive predicted advantage moves
    the control."""
    rows, names = prepared(frame, [control, specialist], extra)
    rows = rows.withColumn("__gain", advantage(control, specialist))
    out = crossfit(rows, names, "__gain", trees, step, 3, 40, seed).withColumnRenamed("__p", "predicted_advantage")
    out = out.join(F.broadcast(fold_scales(rows, "__gain")), "origin")  # a row an origin
    part = F.col("predicted_advantage") / F.greatest(F.col("scale"), F.lit(1e-6))
    alpha = most * F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    blend = gate_blend(F.col(f"pred_{control}"), F.col(f"pred_{specialist}"), F.col("predicted_advantage"), F.col("scale"), most)
    return out.select(*frame.columns, "predicted_advantage", "scale", alpha.alias("alpha"), blend.alias("blend"))
