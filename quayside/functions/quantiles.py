"""Exact ranks and quantiles of a whole table without a task that holds all its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.sources.shared import written


def ranked(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(v, rank) of the column's known values as doubles, ascending from rank 0, and how many there are.

    The values are sorted over range partitions and written; a partition's count gives its first value's rank. NaN
    counts as a value above all others.
    """
    kept = df.select(F.col(column).cast("double").alias("v")).where("v is not null").orderBy("v")
    at = F.monotonically_increasing_id()
    rows = written(kept.select("v", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    counts = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    before, n = [], 0
    for part, k in counts:
        before.append((part, n))
        n += k
    offsets = df.sparkSession.createDataFrame(before, "part long, before long")
    return rows.join(F.broadcast(offsets), "part").select("v", (F.col("at") + F.col("before")).alias("rank")), n


def exact_quantiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row: the linear-interpolated quantiles of the column's known values, by name (null without any)."""
    rows, n = ranked(df, column)
    if not n:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(k) for k in wanted])
    places = {k: q * (n - 1) for k, q in wanted.items()}
    ranks = sorted({r for p in places.values() for r in (int(p), min(int(p) + 1, n - 1))})
    got = {r["rank"]: r.v for r in rows.where(F.col("rank").isin(ranks)).collect()}  # two rows a quantile
    out = {}
    for k, p in places.items():
        low, high = got[int(p)], got[min(int(p) + 1, n - 1)]
        out[k] = low if p == int(p) or low == high else low + (p - int(p)) * (high - low)
    return df.sparkSession.range(1).select(*[F.lit(float(v)).alias(k) for k, v in out.items()])


def group_quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """keys and the linear-interpolated quantiles of the column's known values, by name, for every group with any.

    Groups may be few and as large as the table: all rows are sorted by keys and value over range partitions and written;
    a group's counts by partition give its first value's rank in each. NaN counts as a value above all others.
    """
    kept = df.select(*keys, F.col(column).cast("double").alias("v")).where("v is not null").orderBy(*keys, "v")
    at = F.monotonically_increasing_id()
    rows = written(kept.select(*keys, "v", F.shiftright(at, 33).alias("part"), at.alias("at")))
    group = F.struct(*keys)
    counts = rows.groupBy(group.alias("g"), F.col("part").alias("p")).agg(F.count("*").alias("n"), F.min("at").alias("start"))
    # a row per group and partition that it lies in
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"before": before, "total": F.sum("n").over(Window.partitionBy("g"))})
    placed = rows.withColumn("__g", group).join(counts, F.col("__g").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    placed = placed.withColumn("rank", F.col("at") - F.col("start") + F.col("before"))
    place = {k: (F.col("total") - 1) * F.lit(float(q)) for k, q in wanted.items()}
    near = [F.col("rank").between(F.floor(p), F.floor(p) + 1) for p in place.values()]
    found = placed.where(reduce(lambda a, b: a | b, near)).groupBy("g").agg(
        *[F.max(F.when(F.col("rank") == F.floor(p), F.col("v"))).alias(f"low_{k}") for k, p in place.items()],
        *[F.max(F.when(F.col("rank") == F.floor(p) + 1, F.col("v"))).alias(f"high_{k}") for k, p in place.items()],
        *[F.max(p - F.floor(p)).alias(f"part_{k}") for k, p in place.items()],
    )
    low, high, part = (lambda k: F.col(f"low_{k}")), (lambda k: F.col(f"high_{k}")), (lambda k: F.col(f"part_{k}"))
    value = {k: F.when((part(k) == 0) | (low(k) == high(k)), low(k)).otherwise(low(k) + part(k) * (high(k) - low(k))) for k in wanted}
    return found.select("g.*", *[v.alias(k) for k, v in value.items()])


def share_at_or_below(rows: DataFrame, reference: DataFrame, column: str, name: str) -> DataFrame:
    """rows with `name`: the share of the reference's known values of `column` that are at or under the row's own (null
    where the row has none, or the reference).

    Both are sorted together over range partitions and written; a partition's count of reference values and the counts
    before it give every place, so no task holds more than its partition. NaN counts as a value above all others.
    """
    v = F.col(column).cast("double")
    packed = rows.withColumn("__row", F.struct(*rows.columns))
    known = reference.select(v.alias("v"), F.lit(0).alias("asks"), F.lit(None).cast(packed.schema["__row"].dataType).alias("row")).where("v is not null")
    asked = packed.select(v.alias("v"), F.lit(1).alias("asks"), F.col("__row").alias("row"))
    # a reference value comes before an equal one that asks
    every = known.unionByName(asked.where("v is not null")).orderBy("v", "asks")
    at = F.monotonically_increasing_id()
    every = written(every.select("asks", "row", F.shiftright(at, 33).alias("part"), at.alias("at")))
    counts = sorted((r.part, r.n) for r in every.groupBy("part").agg(F.count_if(F.col("asks") == 0).alias("n")).collect())  # a row per partition
    before, n = [], 0
    for part, k in counts:
        before.append((part, n))
        n += k
    offsets = every.sparkSession.createDataFrame(before, "part long, before long")
    upto = F.count_if(F.col("asks") == 0).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = every.withColumn("upto", upto).where("asks = 1").join(F.broadcast(offsets), "part")
    share = (F.col("before") + F.col("upto")) / F.nullif(F.lit(float(n)), F.lit(0.0))
    return found.select("row.*", share.alias(name)).unionByName(rows.where(v.isNull()).withColumn(name, F.lit(None).cast("double")))
