"""Errors of many linear candidates in one pass: a batch's predictions times all weights is a matrix product, and only sums
leave a task. Nothing is joined, so rows never meet candidates as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a product of rows and candidates at a time; cells of sums that a task holds before it passes them on.
CELLS, HELD = 2_000_000, 4_000_000

SUMS = ("n", "e", "b", "v", "r", "a", "te", "tr", "tv")


def error_sums(rows: DataFrame, columns: list[str], weights: np.ndarray, by: list[str], reference: str | None = None, coef: str | None = None, top: float | None = None, base: str | None = None) -> DataFrame:
    """by..., candidate (the weights' row) and sums over the group's rows: n, e (absolute error), b (error), v (absolute
    actual), r (the reference column's absolute error), a (coef x absolute error), and te, tr, tv: e, r, v of rows whose
    actual is at least `top`.

    weights: (candidates, columns), as many as a driver holds. A candidate predicts the weighted sum of the columns, at least 0; with `base`, the sum
    is a log ratio to that column: expm1(log1p(base) + sum), at least 0. All columns, and `actual`, must be known.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    n_candidates, spec = len(weights), ", ".join([*[f"`{c}` {kinds[c].simpleString()}" for c in by], "candidate int", *[f"{s} double" for s in SUMS]])
    needed = list(dict.fromkeys([*by, *columns, "actual", *[c for c in (reference, coef, base) if c]]))
    turned = np.ascontiguousarray(weights.T)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list = []

        def out():
            for key, sums in held.items():
                keys = [pa.array([k] * n_candidates, t) for k, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(n_candidates), pa.int32()), *[pa.array(s) for s in sums]], names=[*by, "candidate", *SUMS])
            held.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            step = max(1, CELLS // max(n_candidates, 1))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                number: dict[tuple, int] = {}
                group = np.fromiter((number.setdefault(k, len(number)) for k in zip(*[b.column(c).to_pylist() for c in by])), np.int64, b.num_rows) if by else np.zeros(b.num_rows, np.int64)
                if not by:
                    number = {(): 0}
                order = np.argsort(group, kind="stable")
                col = lambda c: np.asarray(b.column(c), float)[order]  # noqa: E731,B023
                y, made = col("actual"), np.column_stack([col(c) for c in columns]) @ turned
                if base:
                    made = np.expm1(np.log1p(col(base))[:, None] + made)
                np.maximum(made, 0.0, out=made)
                made -= y[:, None]
                size = np.abs(made)
                ref = np.nan_to_num(np.abs(col(reference) - y)) if reference else np.zeros(len(y))
                share = col(coef) if coef else np.zeros(len(y))
                high = (y >= top) if top is not None else np.zeros(len(y), bool)
                starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
                add = lambda x: np.add.reduceat(x, starts, axis=0)  # noqa: E731,B023
                one = lambda x: add(x)[:, None] + np.zeros(n_candidates)  # noqa: E731,B023
                parts = [one(np.ones(len(y))), add(size), add(made), one(np.abs(y)), one(ref), add(size * share[:, None]), add(size * high[:, None]), one(ref * high), one(np.abs(y) * high)]
                for i, key in enumerate(number):
                    own = np.array([p[i] for p in parts])
                    held[key] = held[key] + own if key in held else own
                if len(held) * n_candidates * len(SUMS) > HELD:
                    yield from out()
        yield from out()

    made = rows.select(*needed).mapInArrow(run, spec)
    return made.groupBy(*by, "candidate").agg(*[F.sum(s).alias(s) for s in SUMS])


def weights_of(candidates: DataFrame, members: list[str]) -> tuple[list[str], np.ndarray]:
    """Names and weights (w_<member>) of a table of candidates."""
    t = candidates.select("candidate", *[f"w_{m}" for m in members]).toArrow()
    return t.column("candidate").to_pylist(), np.column_stack([np.asarray(t.column(f"w_{m}"), float) for m in members])


def named(sums: DataFrame, names: list[str], weights: np.ndarray, members: list[str]) -> DataFrame:
    """sums with candidates by name, and their weights."""
    rows = [(i, n, *map(float, w)) for i, (n, w) in enumerate(zip(names, weights))]
    table = sums.sparkSession.createDataFrame(rows, "candidate int, __name string, " + ", ".join(f"w_{m} double" for m in members))
    return sums.join(F.broadcast(table), "candidate").withColumn("candidate", F.col("__name")).drop("__name")  # as many as the search was given
