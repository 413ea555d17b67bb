"""Shared folder, row batches and grouping helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS = 1000


def session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quayside-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_piles(rows: DataFrame, n_bytes: str, most: int):
    """rows as Arrow tables of about `most` bytes each (column n_bytes; a larger row alone may exceed it), one after
    another: what a driver can hold and send to all tasks however many rows there are."""
    kept = written(rows)
    total = kept.agg(F.coalesce(F.sum(n_bytes), F.lit(0))).first()[0]
    piles = max(1, -(-int(total) // most))
    if piles > 1:
        kept = written(kept.withColumn("__pile", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(piles))).repartitionByRange("__pile"))
    for i in range(piles):
        own = (kept.where(F.col("__pile") == i).drop("__pile") if piles > 1 else kept).toArrow()
        if own.num_rows:
            yield own


def utf8(column: Column | str) -> Column:
    """A text's UTF-8 bytes; null counts as the empty text."""
    return F.encode(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "UTF-8")


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the key's decimal text, modulo parts."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def runs(batches, key: str):
    """Arrow tables of whole runs of equal `key` from batches that are sorted by it.

    A yielded table holds many runs; only a run that crosses a batch's end waits for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[len(k) - 1].as_py()
        arr = np.asarray(k)
        cut = int(np.searchsorted(arr, last, side="left")) if arr[0] != last else 0
        if held and held[0].column(key)[0].as_py() == last:
            held.append(b)
            continue
        if cut or held:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members: DataFrame, key: str, size: str, per: int) -> DataFrame:
    """Rows dealt into blocks of a key, once for each pair of blocks: task, lo, hi, i."""
    k = F.ceil(F.col(size) / per).cast("int")
    dealt = members.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    pair = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    return pair.withColumn("task", F.xxhash64(key, "lo", "hi"))


def bounds(key: np.ndarray):
    b = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return zip(b[:-1].tolist(), b[1:].tolist())


class Best:
    """The k best rows so far, to which more are added in any order: highest score first, then by id, null ids last.
    Scores under `floor` don't count."""

    def __init__(self, k: int, floor: int = -(1 << 63)):
        self.k, self.floor = k, floor
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a score must have to get in (with a small enough id)."""
        return int(self.score[-1]) if len(self.score) == self.k else self.floor

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> None:
        some = score >= self.least
        if some.any():
            null = np.zeros(len(ids), bool) if null is None else null
            score, ids, null = (np.concatenate([a, b[some]]) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
            by = np.lexsort((ids, null, -score))[: self.k]
            self.score, self.ids, self.null = score[by], ids[by], null[by]


def best_rows(rows: DataFrame, keys: list[str], tie: str, k: int) -> DataFrame:
    """rows with `rank`, the k of highest score of each key, ties to the smaller `tie`, nulls last. They are cut to k in 64
    parts first, so that no key's window grows with the tasks that sent rows."""
    order = [F.desc("score"), F.col(tie).asc_nulls_last()]
    parts = rows.withColumn("__part", F.pmod(F.xxhash64(tie, "score"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col("rank") <= k).drop("__part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
