"""SimHash near duplicates by a grid range join over segment popcounts.

A fingerprint of 64 bits is cut into segments; the bit counts of the segments are a point whose Manhattan distance
to another fingerprint's point never exceeds their Hamming distance. The range join "Manhattan distance at most r"
runs over sub-grids: the segments are dealt into r + 3 groups, and as each unit of distance falls into one group, two
points within r agree exactly on at least 3 of the groups. Every choice of 3 groups is a grid whose cells are equal
sub-points; points that share a cell are compared by Manhattan distance, then exactly by Hamming distance.
Equal fingerprints are one point. A cell's points are dealt into blocks of bounded size, and pairs of blocks are
compared in numpy; only a spanning forest of the links found leaves a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._util import runs, session, table, utf8
from quayside.llm.components import connected_components

SEED = 42
#: Points of one cell that one task compares with each other at once.
BLOCK = 256


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The majority bits of the shingles' hashes; no words: 0."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:z], SEED) for a, z in zip((end - size)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row. Null or wordless texts: 0."""
    session(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield table(schema, b.column("doc_id"), fps)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Of the links a[i]-b[i], those that first join two parts."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out: tuple[list, list] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            out[0].append(x)
            out[1].append(y)
    return out


def _popcounts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments of two bits."""
    x = fp.view(np.uint64)
    two = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return np.stack([(two >> np.uint64(2 * k)).astype(np.uint8) & 3 for k in range(32)], axis=1)


def links(points: DataFrame, radius: int = 3, same: int = 3) -> DataFrame:
    """a, b: links between distinct fingerprints within `radius` bits, enough to connect all that are reachable.

    points: distinct fp long. same: groups of segments that a cell holds, of radius + same; fewer make fewer grids, of
    coarser cells.
    """
    groups = radius + same
    chosen = list(combinations(range(groups), same))
    key_schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])

    def cells(batches):
        for b in batches:
            fp = np.asarray(b.column("fp"))
            seg = _popcounts(fp).astype(np.uint64)
            part = []
            for g in range(groups):  # one number for each group's sub-point: two bits a segment
                own = np.zeros(len(fp), np.uint64)
                for k in range(g, 32, groups):
                    own = own << np.uint64(2) | seg[:, k]
                part.append(own)
            for n, c in enumerate(chosen):
                cell = np.full(len(fp), n, np.uint64)
                for g in c:
                    cell = (cell ^ part[g]) * np.uint64(0x9E3779B97F4A7C15)
                    cell ^= cell >> np.uint64(31)
                yield table(key_schema, cell.view(np.int64), fp)

    spread = points.select("fp").mapInArrow(cells, "cell long, fp long")
    many = spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    members = spread.join(many, "cell")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("cell", "fp", blocks.alias("k"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("i"))
    # a point stands in the pairs (i, i..k-1) and (0..i, i); one block: only in (0, 0)
    paired = dealt.select("cell", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    task = paired.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("task"), "fp")
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for t in runs(batches, "task"):
            key, fp = t.column("task").to_numpy(), t.column("fp").to_numpy()
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            seg = _popcounts(fp).astype(np.int8)
            xs, ys = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                own = fp[s:e].view(np.uint64)
                for i in range(s, e - 1):
                    near = np.flatnonzero(np.abs(seg[i + 1 : e] - seg[i]).sum(axis=1) <= radius)
                    if len(near):
                        near = near[np.bitwise_count(own[i - s + 1 :][near] ^ own[i - s]) <= radius]
                        xs.append(np.full(len(near), fp[i]))
                        ys.append(fp[i + 1 : e][near])
            if xs:
                yield table(edge_schema, *_forest(np.concatenate(xs), np.concatenate(ys)))

    return task.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of at most
    `radius` differing bits. Every row is kept, repeated ones too; null and empty texts have fingerprint zero,
    which links like any other. Rows of a null doc_id keep it and never name a component unless they are alone.
    """
    from quayside.llm._util import written

    fps = written(fingerprints(docs, width))
    points = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(links(points, radius))
    by_fp = points.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    by_fp = written(by_fp)
    named = by_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    of = by_fp.join(named, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
