"""How unusual the known context of a day is: an isolation forest with numeric and category rarity, as a percentile of the
training rows.

Trees are grown in parallel, each on its own sample of bounded size that is drawn by hash, in a group of its own. Rows
are scored where they lie: the forest's size is bounded by its number of trees and their samples, whatever the data's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.quantiles import share_at_or_below
from quayside.functions.scalar import canonical, context_calendar
from quayside.operators.context import category_shares, robust_scale

NUMERIC = ("price", "discount_web", "discount_app", "weekday_sin", "weekday_cos", "month_sin", "month_cos")
CATEGORIES = ("product_id", "campaign_web", "campaign_app", "is_promo")
#: Trees; largest share of the training rows in a tree's sample, and rows of a sample at most.
TREES, SHARE, SAMPLE = 300, 0.75, 1024
#: Weights of the two rarities beside the forest's score; percentile from which a context counts as shifted.
NUMERIC_WEIGHT, CATEGORY_WEIGHT, SHIFTED = 0.10, 0.05, 0.99

_NODES = "tree int, n int, feature array<int>, threshold array<double>, category array<string>, left array<int>, right array<int>, length array<double>"


def with_context(rows: DataFrame) -> DataFrame:
    """rows (with date_key) and the context's columns: calendar cycles, and categories as text with null as 'missing'.
    Columns that rows don't have are null."""
    have = set(rows.columns)
    calendar = context_calendar()
    cycles = {c: calendar[c] for c in NUMERIC if c in calendar}
    numbers = {c: (F.col(c) if c in have else F.lit(None)).cast("double") for c in NUMERIC if c not in calendar}
    texts = {f"context_{c}": canonical(F.col(c)) if c in have else F.lit("missing") for c in CATEGORIES}
    return rows.withColumns({**{f"context_{c}": v for c, v in {**cycles, **numbers}.items()}, **texts})


def path_correction(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, texts: list[np.ndarray], rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree. x: numeric columns; texts: category columns. A split is on a random number between a numeric
    column's ends, or on one value of a category against the others, each such column of one-hot values as likely as a
    numeric one. A leaf's length is its depth and the correction for the rows in it."""
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "category", "left", "right", "length")}
    deepest = math.ceil(math.log2(max(len(x), 2)))

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(out["feature"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("category", None), ("left", -1), ("right", -1), ("length", depth + path_correction(len(rows)))):
            out[k].append(v)
        if depth == deepest or len(rows) < 2:
            return at
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        choices: list[tuple[int, str | None]] = [(j, None) for j in np.flatnonzero(high > low).tolist()]
        for j, column in enumerate(texts):
            values = np.unique(column[rows]).tolist()
            choices += [(x.shape[1] + j, v) for v in values if len(values) > 1]
        if not choices:
            return at
        feature, value = choices[int(rng.integers(len(choices)))]
        if value is None:
            cut = rng.uniform(low[feature], high[feature])
            goes = x[rows, feature] <= cut
            out["threshold"][at] = float(cut)
        else:
            goes = texts[feature - x.shape[1]][rows] == value
            out["category"][at] = value
        out["feature"][at] = feature
        out["left"][at] = node(rows[goes], depth + 1)
        out["right"][at] = node(rows[~goes], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    return out


@dataclass
class Forest:
    """Grown trees as arrays, with categories by number."""

    trees: list[dict]
    numeric: int
    codes: list[dict[str, int]] = field(default_factory=list)

    def __post_init__(self):
        n_texts = 1 + max((f for t in self.trees for f in t["feature"]), default=-1) - self.numeric
        self.codes = [{} for _ in range(max(n_texts, 0))]
        for t in self.trees:
            f = np.array(t["feature"])
            cut = np.array(t["threshold"])
            for i in np.flatnonzero(f >= self.numeric).tolist():
                own = self.codes[f[i] - self.numeric]
                cut[i] = own.setdefault(t["category"][i], len(own))
            t["arrays"] = f, cut, np.array(t["left"]), np.array(t["right"]), np.array(t["length"])
        self.usual = path_correction(max((t["n"] for t in self.trees), default=0))

    def coded(self, texts: list[pa.Array]) -> np.ndarray:
        """Category columns by number; values that no tree knows are -1."""
        out = np.full((len(texts[0]) if texts else 0, len(texts)), -1.0)
        for j, (own, column) in enumerate(zip(self.codes, texts)):
            encoded = column.dictionary_encode()
            known = np.array([own.get(v, -1) for v in encoded.dictionary.to_pylist()], float)
            if len(known):
                out[:, j] = known[np.asarray(encoded.indices)]
        return out

    def score(self, x: np.ndarray, texts: list[pa.Array]) -> np.ndarray:
        """0 to 1: the shorter the paths to a row, the nearer to 1."""
        columns, total = np.hstack([x, self.coded(texts)]), np.zeros(len(x))
        for t in self.trees:
            feature, cut, left, right, length = t["arrays"]
            at, live = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(live):
                f = feature[at[live]]
                live, f = live[f >= 0], f[f >= 0]
                if len(live):
                    v, c = columns[live, f], cut[at[live]]
                    at[live] = np.where(np.where(f < self.numeric, v <= c, v == c), left[at[live]], right[at[live]])
            total += length[at]
        return np.exp2(-total / max(len(self.trees), 1) / max(self.usual, 1e-12))


@dataclass
class ContextRisk:
    """What a fit on training rows has learned."""

    forest: Forest
    medians: dict[str, float]
    scales: dict[str, float]
    shares: DataFrame
    n_train: int
    train: DataFrame | None = None

    def raw(self, rows: DataFrame) -> DataFrame:
        """rows with context_risk_raw: the forest's score less a half, numeric and category rarity with their weights."""
        kept, own = rows.columns, with_context(rows)
        schema = own.withColumn("__isolation", F.lit(0.0)).schema
        numbers, texts, forest = [f"context_{c}" for c in NUMERIC], [f"context_{c}" for c in CATEGORIES], self.forest
        fill = [self.medians.get(c, 0.0) for c in NUMERIC]

        def run(batches):
            for b in batches:
                x = np.column_stack([np.asarray(pc.fill_null(b.column(c), v), float) for c, v in zip(numbers, fill)])
                s = forest.score(np.where(np.isnan(x), fill, x), [b.column(c) for c in texts])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "__isolation"])

        out = own.mapInArrow(run, schema)
        off = [F.abs((F.col(f"context_{c}") - F.lit(self.medians[c])) / F.lit(self.scales[c])) for c in NUMERIC if c in self.medians]
        far = F.greatest(*off, F.lit(0.0)) if off else F.lit(0.0)
        numeric = F.when(F.isnan(far), 0.0).when(far == float("inf"), 10.0).otherwise(F.log1p(far))
        floor = 1.0 / max(self.n_train + 1, 2)
        rare = []
        for c in CATEGORIES:
            own_shares = self.shares.where(F.col("feature") == c).select(F.col("value").alias(f"context_{c}"), F.col("share").alias(f"__share_{c}"))
            out = out.join(own_shares, f"context_{c}", "left")
            rare.append(-F.log(F.greatest(F.coalesce(f"__share_{c}", F.lit(floor)), F.lit(floor))))
        raw = F.col("__isolation") - 0.5 + NUMERIC_WEIGHT * numeric + CATEGORY_WEIGHT * F.greatest(*rare)
        return out.select(*kept, raw.alias("context_risk_raw"))

    def score(self, rows: DataFrame, shifted: float = SHIFTED) -> DataFrame:
        """rows with context_risk_raw, its percentile among the training rows' and whether that counts as a shift."""
        out = share_at_or_below(self.raw(rows), self.train, "context_risk_raw", "context_risk_percentile")
        return out.withColumn("context_shift_flag", F.coalesce(F.col("context_risk_percentile") >= shifted, F.lit(False)))


def sampled(rows: DataFrame, n: int, trees: int, size: int, seed: int) -> DataFrame:
    """tree, place and the columns of rows: `size` rows for each tree, drawn by hash. A pool of about trees x size rows is
    drawn first (all, if there are fewer), so that only these meet the trees."""
    key = F.xxhash64(F.lit(seed), *rows.columns)
    unit = lambda h: F.shiftrightunsigned(h, 11) / float(1 << 53)
    # repeated rows are told apart by a number that any order will do for
    pool = rows.withColumn("__key", F.xxhash64(key, F.monotonically_increasing_id()))
    pool = pool.where(unit(F.col("__key")) < min(1.0, 1.2 * trees * size / max(n, 1)))
    share = min(1.0, size / max(min(n, 1.2 * trees * size), 1) * 1.3 + 0.0)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit(F.xxhash64("__key", t)) < share)
    out = pool.withColumn("tree", F.explode(drawn)).withColumn("__h", F.xxhash64("__key", "tree", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("__h"))
    return out.withColumn("place", place).where(F.col("place") <= size).drop("__key", "__h")


def fit(train: DataFrame, trees: int = TREES, share: float = SHARE, sample: int = SAMPLE, seed: int = 42) -> ContextRisk:
    """Learned from all rows of `train` (product_id, date_key and the context's columns): medians, scales and category
    shares from every row, each tree from at most `share` of them and `sample` rows. ValueError without any."""
    from quayside.sources.shared import written

    numbers, texts = [f"context_{c}" for c in NUMERIC], [f"context_{c}" for c in CATEGORIES]
    rows = written(with_context(train).select(*train.columns, *numbers, *texts))
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    scale = {r.feature: (r["median"], r.scale) for r in robust_scale(rows, numbers).collect()}  # a row a column
    medians = {c: scale[f"context_{c}"][0] for c in NUMERIC if f"context_{c}" in scale}
    scales = {c: scale[f"context_{c}"][1] for c in NUMERIC if f"context_{c}" in scale}
    shares = written(category_shares(rows.select(*[F.col(f"context_{c}").alias(c) for c in CATEGORIES]), list(CATEGORIES)))
    size = max(1, min(sample, int(share * n)))
    filled = rows.select(*[F.coalesce(F.col(f"context_{c}"), F.lit(medians.get(c, 0.0))).alias(c) for c in NUMERIC], *[F.col(t).alias(t) for t in texts])

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        tree = group.column("tree")[0].as_py()
        x = np.column_stack([np.asarray(group.column(c), float) for c in NUMERIC])
        own = grow(x, [np.array(group.column(t).to_pylist(), object).astype(str) for t in texts], np.random.default_rng((seed, tree)))
        return pa.table({"tree": pa.array([tree], pa.int32()), "n": pa.array([len(x)], pa.int32()), "feature": pa.array([own["feature"]], pa.list_(pa.int32())), "threshold": [own["threshold"]], "category": pa.array([own["category"]], pa.list_(pa.string())), "left": pa.array([own["left"]], pa.list_(pa.int32())), "right": pa.array([own["right"]], pa.list_(pa.int32())), "length": [own["length"]]})

    grown = sampled(filled, n, trees, size, seed).groupBy("tree").applyInArrow(one, _NODES)
    # trees x samples, whatever the data's size
    forest = Forest(sorted(grown.toArrow().to_pylist(), key=lambda t: t["tree"]), len(NUMERIC))
    risk = ContextRisk(forest, medians, scales, shares, n)
    risk.train = written(risk.raw(rows.select(*train.columns)).select("context_risk_raw"))
    return risk
