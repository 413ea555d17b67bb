"""Packing by concatenation and cutting.

First pass: every partition encodes its documents and notes each document's offset inside the partition. The
partitions' totals are summed up in order, which gives each partition's place in the one long stream. Second pass:
the stream is cut into windows of a fixed length; a document that crosses a window's end leaves a record on each
side. Only one number per partition passes through a window function; ids never leave their partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm._util import session, table, utf8, written
from quayside.llm.bpe import tokenizer

#: Closes each document; the vocabulary's second entry.
END_ID = 1


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """part, at (ids before the document in its partition), doc_id, n, ids (little-endian)."""
    session(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        own, at = tokenizer(path), 0
        for b in batches:
            ids, lengths = [], []
            close = np.array([end_id], own.dtype).tobytes()
            for one in own.encode_many([raw.decode("utf-8") for raw in b.column("text").to_pylist()]):
                ids.append(one.tobytes() + close)
                lengths.append(len(one) + 1)
            n = np.array(lengths, dtype=np.int64)
            ends = at + np.cumsum(n)
            yield table(schema, b.column("part"), ends - n, b.column("doc_id"), n, ids)
            at = int(ends[-1]) if len(ends) else at

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.mapInArrow(run, "part int, at long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every document ends with END_ID, so an empty or null text still has one id. Sequences are filled to `length`
    without a gap; only the last one of all may be shorter (a reader pads it). No documents: no rows.
    """
    rows = written(tokenised(docs, path))
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def cut(batches):
        dtype = tokenizer(path).dtype
        for b in batches:
            out = [[] for _ in schema]
            for doc, g, n, raw in zip(b.column("doc_id").to_pylist(), b.column("g").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                start = 0
                while start < n:
                    at = (g + start) % length
                    size = min(length - at, n - start)
                    piece = ids[start : start + size]
                    row = (doc, start, size, zlib.crc32(piece.tobytes()), n, (g + start) // length, at, piece.astype(np.int32))
                    for c, v in zip(out, row):
                        c.append(v)
                    start += size
            yield table(schema, *out)

    placed = rows.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("g"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
