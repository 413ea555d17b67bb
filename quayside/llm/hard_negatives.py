"""Hard negatives of anchors by exact integer inner products, as Strassen products of tiles.

A tile is a product of up to TILE anchors and TILE_ROWS candidates in 64-bit whole numbers. Strassen's recursion takes
seven half-size products instead of eight; odd sides are padded with zeros. Its sums may pass 64 bits on the way, but
whole numbers modulo 2^64 add and multiply exactly, so a result that fits is right. Rows with components so large that
a product might not fit are multiplied as whole numbers of any size, on their own.

Anchors travel in piles of bounded size to the candidates, which stay where they are. A first pass keeps each anchor's
best rows of its own label, a second one each positive's best rows of other labels inside its window of scores. A task
holds a mergeable heap for each of these and returns its k rows; heaps of tasks are merged by rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import Best, best_rows, in_piles, session, table, written
from quayside.llm.topk import LEAST, MOST, quantised

#: Sides of a tile, and the side from which on a product is not split any further.
TILE, TILE_ROWS, LEAF = 512, 4096, 16
#: Bytes of anchors that meet the candidates at a time.
PILE_BYTES = 4 << 20


def _even(a: np.ndarray) -> np.ndarray:
    """a with a row and a column of zeros added where its sides are odd."""
    n, m = a.shape
    return np.pad(a, ((0, n % 2), (0, m % 2))) if n % 2 or m % 2 else a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b, modulo 2^64."""
    n, m = a.shape[0], b.shape[1]
    if min(n, a.shape[1], m) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole doubles, row by row; what is beyond a long counts as the nearest long."""
    bound = (2.0**62 / a.shape[1]) ** 0.5
    wide_a, wide_b = (np.abs(x).max(axis=1) >= bound for x in (a, b))
    small = lambda x, wide: np.where(wide[:, None], 0.0, x).astype(np.int64)
    out = strassen(small(a, wide_a), np.ascontiguousarray(small(b, wide_b).T))
    if wide_a.any() or wide_b.any():
        any_size = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape)
        held = lambda x: np.clip(x, LEAST, MOST).astype(np.int64)
        if wide_a.any():
            out[wide_a] = held(any_size(a[wide_a]) @ any_size(b).T)
        if wide_b.any():
            out[:, wide_b] = held(any_size(a) @ any_size(b[wide_b]).T)
    return out


@dataclass
class Rows:
    """Rows of one length: ids, labels, vectors."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    number: np.ndarray | None = None


def _rows(t: pa.Table) -> list[Rows]:
    """By length of their vectors."""
    size = np.asarray(t.column("dims"))
    out = []
    for d in np.unique(size).tolist():
        own = t.filter(pa.array(size == d)).combine_chunks()
        v = np.asarray(own.column("v").combine_chunks().flatten()).reshape(-1, d)
        number = np.asarray(own.column("number")) if "number" in own.column_names else None
        out.append(Rows(np.asarray(own.column("vec_id")), np.asarray(own.column("label")), v, number))
    return out


def _tiles(batches):
    """Batches of candidates as tables of TILE_ROWS rows and more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TILE_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _scored(anchors: list[Rows], batches):
    """(anchor's number, its id and label, its scores, the candidates), tile by tile."""
    for t in _tiles(batches):
        for rows in _rows(t):
            for own in anchors:
                if own.v.shape[1] != rows.v.shape[1]:
                    continue
                for a in range(0, len(own.ids), TILE):
                    part = slice(a, a + TILE)
                    scores = products(own.v[part], rows.v)
                    for i, number in enumerate(own.number[part].tolist()):
                        yield number, own.ids[a + i], own.labels[a + i], scores[i], rows


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative score n with low * p <= 100 * n <= high * p, without products that leave 64 bits."""
    whole, rest = np.divmod(positive, 100)
    return low * whole - (-low * rest) // 100, high * whole + high * rest // 100


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors, anchors: vec_id, embedding, label. A component counts as floor(scale * component). An anchor's positives are
    its `positives` rows of its label with the highest inner products; a positive's negatives are the `negatives` rows of
    other labels with the highest products n among those with low * p <= 100 * n <= high * p, p the positive's product.
    Ties go to the smaller vec_id. Rows whose vec_id, label or vector is null, whose vector is empty or has a null or
    non-finite component take no part; rows of an anchor's own vec_id and of another length are nothing to it. Rows of
    one vec_id are different rows, also as anchors. A product beyond a long counts as the nearest long. Anchors without
    positives, and positives without negatives, have no rows. Other columns are left alone.
    """
    spark = vectors.sparkSession
    session(spark)

    def whole_numbers(df):
        return quantised(df.where("label is not null"), scale, "label").withColumn("dims", F.size("v"))

    rows = written(whole_numbers(vectors).select("vec_id", F.col("label").cast("long").alias("label"), "v", "dims"))
    asked = whole_numbers(anchors).select("vec_id", F.col("label").cast("long").alias("label"), "v", "dims", F.monotonically_increasing_id().alias("number"), (8 * F.col("dims") + 64).alias("size"))
    near_schema = pa.schema([("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    far_schema = pa.schema([("anchor_id", pa.int64()), ("number", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    out = None
    for pile in in_piles(asked, "size", PILE_BYTES):
        own = _rows(pile)

        def near(batches, own=own):
            heaps: dict[int, Best] = {}
            for number, anchor, label, scores, rows_ in _scored(own, batches):
                some = np.flatnonzero((rows_.labels == label) & (rows_.ids != anchor))
                heaps.setdefault(number, Best(positives)).add(scores[some], rows_.ids[some])
            for number, best in heaps.items():
                yield table(near_schema, np.full(len(best.ids), number), best.ids, best.score)

        # at most `positives` rows for each of the pile's anchors
        found = best_rows(rows.mapInArrow(near, "number long, vec_id long, score long"), ["number"], "vec_id", positives).toArrow()
        mine_: dict[int, list[tuple[int, int, int, int, int]]] = {}
        score = np.asarray(found.column("score"))
        least, most = window(score, low, high)
        for number, place, i, p, a, z in zip(*(found.column(c).to_pylist() for c in ("number", "rank", "vec_id", "score")), least.tolist(), most.tolist()):
            if a <= z:
                mine_.setdefault(number, []).append((place, i, p, a, z))

        def far(batches, own=own, mine_=mine_):
            heaps: dict[tuple, Best] = {}
            for number, anchor, label, scores, rows_ in _scored(own, batches):
                wanted = mine_.get(number)
                if not wanted:
                    continue
                some = np.flatnonzero((rows_.labels != label) & (rows_.ids != anchor) & (scores >= min(x[3] for x in wanted)) & (scores <= max(x[4] for x in wanted)))
                if not len(some):
                    continue
                s, ids = scores[some], rows_.ids[some]
                by = np.lexsort((ids, -s))
                s, ids = s[by], ids[by]
                for place, i, p, a, z in wanted:
                    start, end = np.searchsorted(-s, -z, "left"), np.searchsorted(-s, -a, "right")
                    heaps.setdefault((anchor, number, place, i, p), Best(negatives)).add(s[start:end][:negatives], ids[start:end][:negatives])
            for key, best in heaps.items():
                yield table(far_schema, *(np.full(len(best.ids), x) for x in key), best.ids, best.score)

        sent = rows.mapInArrow(far, "anchor_id long, number long, place int, positive_id long, positive_score long, vec_id long, score long")
        made = best_rows(sent, ["number", "place"], "vec_id", negatives)
        made = made.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = made if out is None else out.unionByName(made)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
