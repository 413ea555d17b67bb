"""Exact top-k by inner product with a bit-sliced index.

Rows are dealt into blocks; a block keeps each attribute's quantised value as bit slices, one bitmap over its rows
per attribute and bit. For a block of queries, the slices that a query's weights select are added by full adders on
whole bitmaps, which leaves the score in bit slices. From the most significant slice downward the k-th largest score
is found; rows within the quantisation's error of it are the boundary, and are resolved by exact integer products.
Queries travel to the index in piles of bounded size; the index stays where it is, and a task returns k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import Best, best_rows, in_piles, session, table, written
from quayside.llm.vectors import whole

#: Bits of an attribute that are sliced; the rest is the boundary's error.
SLICED = 6
ROWS, QUERIES = 8192, 256
#: Bytes of queries that meet the index at a time.
PILE_BYTES = 4 << 20
#: Bounds of a score: what is beyond counts as the nearest of these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1

INDEX = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("shift", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("slices", pa.binary())])


def _slices(high: np.ndarray, bits: int) -> np.ndarray:
    """(dims, bits, words): bitmaps over rows of the unsigned values' bits."""
    n, d = high.shape
    padded = np.zeros((-(-n // 64) * 64, d), np.uint16)
    padded[:n] = high
    out = [np.packbits((padded >> b & 1).astype(np.uint8), axis=0, bitorder="little") for b in range(bits)]
    return np.ascontiguousarray(np.stack(out, axis=0).transpose(2, 0, 1)).view(np.uint64)


def _add(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bit slices of the sum of bitmaps filed by weight; full adders three at a time."""
    out, w = [], 0
    while columns:
        own = columns.pop(w, [])
        up = columns.setdefault(w + 1, []) if len(own) > 1 else None
        while len(own) > 2:
            a, b, c = own.pop(), own.pop(), own.pop()
            x = a ^ b
            own.append(x ^ c)
            up.append((a & b) | (x & c))
        if len(own) == 2:
            a, b = own
            own = [a ^ b]
            up.append(a & b)
        out.append(own[0] if own else None)
        w += 1
    return out


def _kth(slices: list[np.ndarray], k: int, rows: np.ndarray) -> np.ndarray:
    """Of each query's bitmap of rows, those with one of the k largest scores, ties of the last one included, most significant first."""
    sure, open_ = np.zeros_like(slices[-1]), rows
    for s in reversed(slices):
        more = sure | (open_ & s)
        enough = (np.bitwise_count(more).sum(axis=1, dtype=np.int64) >= k)[:, None]
        sure = np.where(enough, sure, more)
        open_ = np.where(enough, open_ & s, open_ & ~s)
    return sure | open_


def _at_least(slices: list[np.ndarray], bound: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each query's bitmap of rows, those whose score is at least the query's bound."""
    over, same = np.zeros_like(slices[-1]), rows
    for i in range(len(slices) - 1, -1, -1):
        bit = (bound >> i & 1).astype(bool)[:, None]
        over = np.where(bit, over, over | (same & slices[i]))
        same = np.where(bit, same & slices[i], same & ~slices[i])
    return over | same


def block_top(ids, values, slices, shift, query_ids, queries, k):
    """(query id, row ids, scores) for each query: its k best rows of a block, ties to smaller ids."""
    n, d = values.shape
    words = slices.shape[2]
    all_rows = np.zeros(words, np.uint64)
    all_rows.view(np.uint8)[: n // 8] = 255
    if n % 8:
        all_rows.view(np.uint8)[n // 8] = (1 << n % 8) - 1
    size, negative = np.abs(queries), queries < 0
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    columns: dict[int, list] = {}
    for j in range(d):
        flip = np.where(negative[:, j], ones, np.uint64(0))[:, None]
        for c in range(int(size[:, j].max()).bit_length()):
            mask = np.where(size[:, j] >> c & 1, ones, np.uint64(0))[:, None]
            if not mask.any():
                continue
            for b in range(slices.shape[1]):
                columns.setdefault(b + c, []).append((slices[j, b][None] ^ flip) & mask)
        for w in sorted(columns):  # keep few bitmaps at a time
            while len(columns[w]) > 6:
                x, y, z = columns[w].pop(), columns[w].pop(), columns[w].pop()
                columns[w].append(x ^ y ^ z)
                columns.setdefault(w + 1, []).append((x & y) | ((x ^ y) & z))
    zero = np.zeros((len(queries), words), np.uint64)
    total = [zero if s is None else s for s in _add(columns)] or [zero]
    # rows of the query's own vec_id do not count: they are no candidates
    rest = np.repeat(all_rows[None], len(queries), axis=0)
    order = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[order], query_ids, side=x) for x in ("left", "right"))
    for i in np.flatnonzero(last > first):
        own = np.zeros(words * 64, np.uint8)
        own[order[first[i] : last[i]]] = 1
        rest[i] &= ~np.packbits(own, bitorder="little").view(np.uint64)
    best = _kth(total, k, rest)
    # the k-th score: the smallest among the best
    low, live = np.zeros(len(queries), np.int64), best
    for i in range(len(total) - 1, -1, -1):
        without = live & ~total[i]
        some = without.any(axis=1)
        live = np.where(some[:, None], without, live)
        low += np.where(some, 0, 1 << i)
    error = ((1 << shift) - 1) * size.sum(axis=1)
    bound = np.maximum(low - -(-error // (1 << shift)) - 1, 0)
    near = _at_least(total, bound, rest)
    out = []
    for i in range(len(queries)):
        rows = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little")[:n])
        score = values[rows] @ queries[i]
        top = np.lexsort((ids[rows], -score))[:k]
        out.append((query_ids[i], ids[rows][top], score[top]))
    return out


def wide_top(ids, values, query_ids, queries, k):
    """As block_top, for numbers of any size: every product as a whole number, scores held to LEAST and MOST."""
    rows, out = [[int(x) for x in r] for r in values], []
    for q, own in zip(query_ids.tolist(), queries):
        q_row = [int(x) for x in own]
        scored = sorted((-min(max(sum(a * b for a, b in zip(q_row, r)), LEAST), MOST), i) for i, r in zip(ids.tolist(), rows) if i != q)[:k]
        out.append((q, np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], np.int64)))
    return out


def quantised(vectors: DataFrame, scale: int = 1024, *more: str) -> DataFrame:
    """vec_id, v: floor(scale * component) of the vectors that take part, as whole doubles (a power of two as the scale
    only moves the exponent; what overflows is the largest double), and the columns `more`."""
    top = F.lit(1.7976931348623157e308)
    held = lambda x: F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), -top), top)
    v = F.transform("embedding", lambda x: F.when(F.abs(held(x)) < 2.0**53, F.floor(held(x)).cast("double")).otherwise(held(x)))
    kept = vectors.where(whole("embedding") & F.col("vec_id").isNotNull())
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more)


def _dealt(df: DataFrame, per: int) -> tuple[DataFrame, int]:
    """df, which is written, with a block for every row: rows of one vec_id are dealt over all blocks."""
    blocks = max(1, -(-df.count() // per))
    return df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest integer inner product, itself excluded.

    vectors, queries: vec_id, embedding. Ties go to the smaller vec_id. Vectors that are null, empty, or hold null or
    non-finite components take no part; vectors of another length than the query's neither, nor rows of a null vec_id.
    Rows of one vec_id are different rows. A score beyond a long counts as the nearest long. Fewer than k rows: all of
    them; none: no rows.
    """
    spark = vectors.sparkSession
    session(spark)
    # rows whose products may not fit a long have blocks of their own
    wide = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))) >= F.sqrt(F.lit(2.0**62) / F.size("v"))
    rows, _ = _dealt(written(quantised(vectors, scale).withColumns({"dims": F.size("v"), "wide": wide})), ROWS)

    def build(group: pa.Table) -> pa.Table:
        v, ids = np.asarray(group.column("v").combine_chunks().flatten()).reshape(group.num_rows, -1), np.asarray(group.column("vec_id"))
        if group.column("wide")[0].as_py():
            shift, s = 0, None
        else:
            whole_ = v.astype(np.int64)
            lowest = int(whole_.min())
            span = int(whole_.max()) - lowest
            shift = max(0, span.bit_length() - SLICED)
            s = _slices(((whole_ - lowest) >> shift).astype(np.uint16), max(1, (span >> shift).bit_length())).tobytes()
        return pa.Table.from_batches([table(INDEX, [int(group.column("block")[0].as_py())], [v.shape[1]], [shift], [ids.astype(np.int64).tobytes()], [v.tobytes()], [s])])

    grouped = rows.select("block", "vec_id", "v", "dims", "wide").groupBy("block", "dims", "wide")
    index = written(grouped.applyInArrow(build, "block long, dims int, shift int, ids binary, values binary, slices binary"))
    asked = quantised(queries, scale).withColumns({"dims": F.size("v"), "wide": wide, "number": F.monotonically_increasing_id(), "size": 8 * F.size("v") + 64})
    found, out = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]), None
    for pile in in_piles(asked, "size", PILE_BYTES):
        # queries of one length and kind together, QUERIES at a time
        parts = []
        dims, kinds = np.asarray(pile.column("dims")), np.asarray(pile.column("wide"))
        for d in np.unique(dims).tolist():
            for kind in (False, True):
                own = pile.filter(pa.array((dims == d) & (kinds == kind))).combine_chunks()
                if not own.num_rows:
                    continue
                v, ids, numbers = np.asarray(own.column("v").combine_chunks().flatten()).reshape(-1, d), np.asarray(own.column("vec_id")), np.asarray(own.column("number"))
                parts += [(d, kind, ids[i : i + QUERIES], v[i : i + QUERIES], numbers[i : i + QUERIES]) for i in range(0, own.num_rows, QUERIES)]

        def meet(batches, parts=parts):
            best: dict[tuple[int, int], Best] = {}
            for b in batches:
                for p in b.to_pylist():
                    d = p["dims"]
                    v, ids = np.frombuffer(p["values"]).reshape(-1, d), np.frombuffer(p["ids"], np.int64)
                    for dims_, wide_, qids, q, numbers in parts:
                        if dims_ != d:
                            continue
                        if wide_ or p["slices"] is None:
                            got = wide_top(ids, v, qids, q, k)
                        else:
                            s = np.frombuffer(p["slices"], np.uint64).reshape(d, -1, -(-len(ids) // 64))
                            got = block_top(ids, v.astype(np.int64), s, p["shift"], qids, q.astype(np.int64), k)
                        for i, (_, own, score) in enumerate(got):
                            best.setdefault((int(numbers[i]), int(qids[i])), Best(k)).add(score, own)
            for (number, query), top in best.items():
                yield table(found, np.full(len(top.ids), number), np.full(len(top.ids), query), top.ids, top.score)

        made = best_rows(index.select("dims", "shift", "ids", "values", "slices").mapInArrow(meet, "number long, query_id long, vec_id long, score long"), ["number"], "vec_id", k)
        made = made.select("query_id", "rank", "vec_id", "score")
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
