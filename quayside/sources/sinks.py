"""Writers of forecasts and evidence, and fingerprints of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalar import submission


def write_submission(predictions: DataFrame, path: str, pred: str = "pred") -> None:
    """product_id, date, whole quantities (half to even), as Parquet and CSV below path."""
    rows = predictions.select("product_id", "target_date", submission(F.col(pred)).alias("quantity"))
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_folds(oof: DataFrame, path: str) -> None:
    """Out-of-fold rows by origin; only the origins at hand are replaced, so an interrupted run can go on."""
    oof.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(path)


def missing_folds(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Origins that no stored row has."""
    return wanted.select("origin").distinct().join(stored.select("origin").distinct(), "origin", "left_anti")


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that are not finite become null; dates and timestamps ISO text."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            out[name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind == "date":
            out[name] = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            out[name] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return df.withColumns(out)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, nulls, and the sum of a word of each row's md5, whatever the order of rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")
    nulls = sum((F.col(c).isNull().cast("long") for c in columns[1:]), F.col(columns[0]).isNull().cast("long"))
    return df.agg(F.count("*").alias("n_rows"), F.sum(nulls).alias("n_nulls"), F.coalesce(F.sum(word), F.lit(0)).cast("string").alias("digest"))


def forecast_table(forecasts: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """One row per key and model: the raw prediction and whole units (half to even)."""
    long = forecasts.unpivot(keys, [F.col(f"pred_{m}").alias(m) for m in models], "model", "raw")
    return long.withColumn("quantity", submission(F.col("raw")))


def payload(state: DataFrame, tail: int = 90) -> DataFrame:
    """Per product: its last days as a sorted array of (date_key, quantity); to_json makes the report's text of it."""
    w = Window.partitionBy("product_id").orderBy(F.desc("date_key"))
    rows = state.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= tail)
    return rows.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("date_key", "quantity"))).alias("history"))


def boundary(rows: DataFrame, benchmark: str, columns: list[str]) -> DataFrame:
    """One row on the data before a benchmark's start: first and last day, rows kept and left out, fingerprint."""
    before = rows.where(F.col("date_key") < F.lit(benchmark).cast("date"))
    span = rows.agg(F.min("date_key").alias("first"), F.max(F.when(F.col("date_key") < F.lit(benchmark).cast("date"), F.col("date_key"))).alias("last"), F.count_if(F.col("date_key") >= F.lit(benchmark).cast("date")).alias("left_out"))
    return span.crossJoin(F.broadcast(fingerprint(before, columns)))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Report tables as CSV with a header, a folder each. They have a row per model, origin or the like: one file each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
