"""The product x day panel: derivation, checks, date coercion and the gap-filled calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.sources.shared import written

#: Campaign codes beside -1 (none).
CAMPAIGN_CODES = [0, 1, 2, 3, 4, 5, 16, 18, 19]
#: What is known of a future day; quantities and availability are not.
KNOWN_FUTURE = ["product_id", "date_key", "campaign_web", "campaign_app", "discount_web", "discount_app", "is_promo", "price"]
COVARIATES = ["is_promo", "campaign_web", "campaign_app", "discount_web", "discount_app", "price"]


def _campaign(code: Column) -> Column:
    k = (code % 40).cast("int")
    return F.when(k < len(CAMPAIGN_CODES), F.get(F.array(*map(F.lit, CAMPAIGN_CODES)), k)).otherwise(-1)


def series_numbers(series: DataFrame) -> DataFrame:
    """series, product_id: every distinct series, numbered from 1 in ascending order.

    They are sorted over range partitions and written; a partition's count gives the next one's first number, so no task
    holds more than its partition.
    """
    at = F.monotonically_increasing_id()
    rows = series.select("series").distinct().orderBy("series")
    rows = written(rows.select("series", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, n = [], 1
    for part, k in sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row per partition
        before.append((part, n))
        n += k
    offsets = series.sparkSession.createDataFrame(before, "part long, before long")
    return rows.join(F.broadcast(offsets), "part").select("series", (F.col("at") + F.col("before")).alias("product_id"))


def sales_panel(spark: SparkSession, sf_dir: str, grain: tuple[str, ...] = ("p_brand",)) -> DataFrame:
    """One row per series and day of lineitem x part; series are numbered in the order of the grain."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice", F.concat_ws("|", *grain).alias("series"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey", "l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("date_key")
    )
    discount = F.round(F.avg("l_discount"), 6)
    days = line.join(part, line.l_partkey == part.p_partkey).groupBy("series", "date_key").agg(
        (~F.bool_and(F.col("l_returnflag") == "R")).alias("available"),
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), F.lit(0.0)).alias("quantity_app"),
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), F.lit(0.0)).alias("quantity_web"),
        (discount >= 0.08).alias("is_promo"),
        _campaign(F.min("l_orderkey")).alias("campaign_web"),
        _campaign(F.max("l_orderkey")).alias("campaign_app"),
        F.when(discount >= 0.09, 100 * discount).otherwise(0.0).alias("d"),
        F.round(F.avg("p_retailprice"), 6).alias("price"),
    )
    return days.join(series_numbers(part), "series").select(
        "product_id", "date_key", "available", "quantity_app", "quantity_web", (F.col("quantity_app") + F.col("quantity_web")).alias("quantity"),
        "is_promo", "campaign_web", "campaign_app", F.col("d").alias("discount_web"), F.when(F.col("quantity_app") > 0, F.col("d")).otherwise(0.0).alias("discount_app"), "price",
    )


def contiguous_ids(panel: DataFrame) -> DataFrame:
    """n_ids, lowest, highest, contiguous: whether ids run from 1 to their number."""
    out = panel.agg(F.count_distinct("product_id").alias("n_ids"), F.min("product_id").alias("lowest"), F.max("product_id").alias("highest"))
    return out.withColumn("contiguous", (F.col("lowest") == 1) & (F.col("highest") == F.col("n_ids")))


def coerce_epoch(df: DataFrame, column: str) -> DataFrame:
    """A numeric date column as a date; its unit (s, ms, us, ns) is told by the median's size."""
    middle = df.agg(F.median(column).alias("__middle"))
    c, m = F.col(column).cast("long"), F.abs("__middle")
    day = F.when(m < 1e11, F.timestamp_seconds(c)).when(m < 1e14, F.timestamp_millis(c)).when(m < 1e17, F.timestamp_micros(c)).otherwise(F.timestamp_micros(F.floor(c / 1000).cast("long")))
    return df.crossJoin(F.broadcast(middle)).withColumn(column, F.to_date(day)).drop("__middle")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; ValueError if a key has more than one row."""
    if found := duplicate_keys(df, keys).limit(5).collect():
        raise ValueError(f"keys {keys} are not unique: {found}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_artefact(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A CSV or JSON table; an empty frame of the schema where there is none."""
    from pyspark.errors import AnalysisException

    try:
        reader = spark.read.schema(schema)
        return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def sanitize_future(future: DataFrame) -> DataFrame:
    """Only the columns known ahead, and one row per key."""
    return require_unique(require_columns(future, KNOWN_FUTURE).select(*KNOWN_FUTURE), ["product_id", "date_key"])


def fill_calendar(panel: DataFrame) -> DataFrame:
    """Every day from a product's first to its last; gap rows have null quantities and availability, and the
    covariates of the day before (or, ahead of any, of the next)."""
    span = panel.groupBy("product_id").agg(F.min("date_key").alias("a"), F.max("date_key").alias("b"))
    spine = span.select("product_id", F.explode(F.sequence("a", "b")).alias("date_key"))
    rows = spine.join(panel.withColumn("present", F.lit(True)), ["product_id", "date_key"], "left").withColumn("is_gap", F.col("present").isNull()).drop("present")
    w = Window.partitionBy("product_id")
    back = w.orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc("date_key")).rowsBetween(Window.unboundedPreceding, 0)  # a running frame, unlike one that looks ahead
    return rows.withColumns({c: F.coalesce(F.last(c, True).over(back), F.last(c, True).over(ahead)) for c in COVARIATES})


def reference_dates(filled: DataFrame) -> DataFrame:
    """first_seen, first_available (or else first_seen) and median price of every product."""
    return filled.groupBy("product_id").agg(
        F.min("date_key").alias("first_seen"),
        F.coalesce(F.min(F.when(F.col("available") & ~F.col("is_gap"), F.col("date_key"))), F.min("date_key")).alias("first_available"),
        F.median("price").alias("price_ref"),
    )
