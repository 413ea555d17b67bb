"""Near duplicates among embeddings by lattice hashing.

Each table projects the normed vectors at random to two blocks of eight dimensions and decodes each block to the
nearest point of the lattice E8; the two points are the cell. A vector also probes the next nearest lattice point of
either block. Vectors that meet in a cell of any table are compared by cosine in double precision; a task passes on a
spanning forest of the links it finds. Links only join vectors of one component, so the components' members are
then compared in blocks, which counts every vector's links once. Equal vectors are one point with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import block_pairs, bounds, runs, session, table, written
from quayside.llm.components import connected_components
from quayside.llm.simhash import _forest
from quayside.llm.vectors import unit, whole

TABLES, BLOCKS, SCALE, SEED = 10, 2, 0.6, 8
#: Vectors of a cell or component that one task compares with as many others at once.
TOGETHER = 512


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors: two coordinates of 1 or -1, or all of 1/2 or -1/2 with an even number of minus."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        v = np.array([0.5 - (m >> k & 1) for k in range(8)])
        if m.bit_count() % 2 == 0:
            out.append(v)
    return np.array(out)


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: of D8 or of D8 shifted by 1/2, whichever is nearer."""

    def d8(y):
        f = np.rint(y)
        odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
        r = y[odd] - f[odd]
        worst = np.abs(r).argmax(axis=1)
        f[odd, worst] += np.where(r[np.arange(len(odd)), worst] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def cells(unit: np.ndarray) -> np.ndarray:
    """(rows, tables * (1 + BLOCKS)) cell numbers: own cell, then a probe for each block."""
    n, d = unit.shape
    roots, out = e8_roots(), []
    mix = np.random.default_rng(SEED).integers(1, 1 << 62, size=(BLOCKS, 8), dtype=np.int64) | 1
    for t in range(TABLES):
        rng = np.random.default_rng([SEED, t, d])
        points, next_ = [], []
        for k in range(BLOCKS):
            y = unit @ (rng.standard_normal((d, 8)) * SCALE) + rng.random(8)
            p = e8_nearest(y)
            toward = ((y - p) @ roots.T).argmax(axis=1)
            points.append(((2 * p).astype(np.int64) * mix[k]).sum(axis=1))
            next_.append(((2 * (p + roots[toward])).astype(np.int64) * mix[k]).sum(axis=1))
        salt = (t + 1) * 0x9E3779B97F4A7C1 + d
        out.append(sum(points) ^ salt)
        out += [sum(points) - points[k] + next_[k] ^ salt for k in range(BLOCKS)]
    return np.stack(out, axis=1)


def _unit(col: pa.Array) -> np.ndarray:
    return unit(np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    length neither. Rows with equal vectors link with each other. Repeated vec_ids are different rows. Components of any
    size count: a vector is scaled by its largest one before its length is taken. No rows: none.
    """
    session(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = whole("v") & F.exists("v", lambda x: x != 0)
    fit = rows.where(usable)
    # equal vectors are one point, by all their components; the hash only deals them
    marked = fit.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("hash", F.xxhash64("v"))
    points = marked.groupBy("hash", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = written(points.withColumn("id", F.monotonically_increasing_id()))

    def to_cells(batches):
        schema = pa.schema([("id", pa.int64()), ("cell", pa.int64())])
        for b in batches:
            size = np.asarray(b.column("dims"))
            for d in np.unique(size):
                own = b.filter(pa.array(size == d))
                c = cells(_unit(own.column("v")))
                yield table(schema, np.repeat(np.asarray(own.column("id")), c.shape[1]), c.ravel())

    spread = points.select("id", "v", F.size("v").alias("dims")).mapInArrow(to_cells, "id long, cell long").distinct()
    many = spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = block_pairs(spread.join(many, "cell"), "cell", "n", TOGETHER).select("task", "id")
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches):
        for t in runs(batches, "task"):
            ids = t.column("id").to_numpy()
            v = t.column("v").combine_chunks()
            for s, e in bounds(t.column("task").to_numpy()):
                u = _unit(v.slice(s, e - s))
                x, y = np.nonzero(np.triu(u @ u.T >= threshold, 1))
                if len(x):
                    yield table(edge, *_forest(ids[s:e][x], ids[s:e][y]))

    edges = met.join(points.select("id", "v"), "id").repartition("task").sortWithinPartitions("task").mapInArrow(link, "a long, b long")
    comps = written(connected_components(edges))
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    members = block_pairs(comps.withColumnRenamed("node", "id").join(sizes, "component"), "component", "n", TOGETHER)
    members = members.select("task", "id", "i", "lo", "hi").join(points.select("id", "v", "weight"), "id")
    degree = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for t in runs(batches, "task"):
            ids, w = t.column("id").to_numpy(), t.column("weight").to_numpy()
            i, lo, hi = (t.column(c).to_numpy() for c in ("i", "lo", "hi"))
            v = t.column("v").combine_chunks()
            for s, e in bounds(t.column("task").to_numpy()):
                u = _unit(v.slice(s, e - s))
                close = u @ u.T >= threshold
                if lo[s] != hi[s]:  # two blocks: only pairs across
                    close &= i[s:e, None] != i[None, s:e]
                np.fill_diagonal(close, False)
                yield table(degree, ids[s:e], close @ w[s:e])

    degrees = members.repartition("task").sortWithinPartitions("task").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    known = points.select("id", "least", "weight").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = written(known.join(degrees, "id", "left"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    out = known.join(named, "component").select("id", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named_rows = marked.join(points.select("hash", "v", "id"), ["hash", "v"]).select("vec_id", "id")
    linked = named_rows.join(out, "id").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
