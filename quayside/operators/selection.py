"""Choosing what goes into a blend or a model, step by step: members by their cross-fitted gain and how different their
errors are, feature groups by the error that they take away. Each step is one pass over the rows, whatever the number of
options; the small tables of sums that come back are weighed on the driver."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.quantiles import exact_quantiles
from quayside.functions.scalar import stratum
from quayside.operators.candidates import SUMS, error_sums
from quayside.operators.mixtures import known
from quayside.plans.evaluate import STRATA
from quayside.plans.meta import gram, matrices, ridge
from quayside.sources.shared import written


def co_moments(frame: DataFrame, members: list[str]) -> DataFrame:
    """a, b, n, covariance: population covariances of the members' residuals (actual less prediction), a <= b by place, over
    the rows that all members can be scored on. One aggregation."""
    rows = known(frame, members).select(*[(F.col("actual") - F.col(f"pred_{m}")).alias(m) for m in members])
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i:]]
    wide = rows.agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)])
    return wide.select("n", F.explode(each).alias("x")).select("x.a", "x.b", "n", "x.covariance")


def weights_in_steps(k: int, steps: int) -> np.ndarray:
    """All weights of k members in 1/steps that sum to 1."""
    cuts = np.array(list(combinations_with_replacement(range(steps + 1), k - 1)), float).reshape(-1, k - 1)
    edges = np.hstack([np.zeros((len(cuts), 1)), cuts, np.full((len(cuts), 1), steps)])
    return np.diff(edges, axis=1) / steps


def _by_origin(sums: DataFrame, n: int) -> tuple[list, dict[str, np.ndarray]]:
    """Origins, and each sum as (origins, candidates)."""
    rows = sums.toArrow().to_pylist()
    origins = sorted({r["origin"] for r in rows})
    at = {o: i for i, o in enumerate(origins)}
    out = {s: np.zeros((len(origins), n)) for s in SUMS}
    for r in rows:
        for s in SUMS:
            out[s][at[r["origin"]], r["candidate"]] = r[s]
    return origins, out


def crossfitted(e: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each origin the candidate of least error over the other origins (the first of equals)."""
    rest, volume = e.sum(axis=0) - e, v.sum(axis=0) - v
    return np.argmin(np.round(rest / np.maximum(volume, 1e-12), 12), axis=1)


def diverse_members(frame: DataFrame, members: list[str], control: str, families: dict[str, str], top: int, anomaly: tuple[str, ...] = ("statistical", "autoencoder", "hybrid"), steps: int = 5) -> DataFrame:
    """step, candidate, family, improvement, top_change, correlation, diversity, score, chosen of every option of every step.

    From the control on, a step adds the member of highest score: relative improvement of a convex blend of the chosen and
    the option over the control, its weights (in 1/steps) fitted without the origin they are judged on; less 0.12 x the
    worsening over the top tenth of actuals; plus 0.04 x (1 - |correlation|) of the option's residuals with the chosen
    members' mean residuals. Ends after `top` members. If none is of an anomaly family, the best-ranked option of one takes
    the last one's place (step 0, reason in `family`). Equal scores: the first of `members`.
    """
    rows = written(known(frame, members))
    cut = exact_quantiles(rows, "actual", {"cut": 0.9}).first().cut
    moments = {(r["a"], r["b"]): r["covariance"] or 0.0 for r in co_moments(frame, members).collect()}  # a row a pair of members
    cov = lambda a, b: moments.get((a, b), moments.get((b, a), 0.0))
    place = {m: i for i, m in enumerate(members)}
    chosen, rest, out, first = [control], [m for m in members if m != control], [], {}
    step = 0
    while rest and len(chosen) < top + 1 and cut is not None:
        step += 1
        grid = weights_in_steps(len(chosen) + 1, steps)
        weights = np.zeros((len(rest) * len(grid), len(members)))
        for i, option in enumerate(rest):
            weights[i * len(grid) : (i + 1) * len(grid), [place[m] for m in [*chosen, option]]] = grid
        _, s = _by_origin(error_sums(rows, [f"pred_{m}" for m in members], weights, ["origin"], f"pred_{control}", top=cut), len(weights))
        scored = []
        for i, option in enumerate(rest):
            own = {k: x[:, i * len(grid) : (i + 1) * len(grid)] for k, x in s.items()}
            pick, o = crossfitted(own["e"], own["v"]), np.arange(len(own["e"]))
            e, te, r, tr = own["e"][o, pick].sum(), own["te"][o, pick].sum(), own["r"][:, 0].sum(), own["tr"][:, 0].sum()
            gain, change = (float(1 - e / r) if r > 0 else 0.0), (float(te / tr - 1) if tr > 0 else 0.0)
            left = sum(cov(a, b) for a in chosen for b in chosen) / len(chosen) ** 2
            both, right = sum(cov(a, option) for a in chosen) / len(chosen), cov(option, option)
            correlation = float(np.clip(both / np.sqrt(left * right), -1, 1)) if min(left, right) > 1e-12 else 1.0  # constant residuals go with any
            score = gain - 0.12 * max(change, 0.0) + 0.04 * (1 - abs(correlation))
            scored.append([step, option, families.get(option), gain, change, correlation, 1 - abs(correlation), score, False])
        if step == 1:
            first = {x[1]: x[7] for x in scored}
        best = max(range(len(scored)), key=lambda i: (round(scored[i][7], 12), -i))
        scored[best][-1] = True
        chosen.append(rest.pop(best))
        out += scored
    if not any(families.get(m) in anomaly for m in chosen):
        options = sorted((m for m in first if families.get(m) in anomaly), key=lambda m: -round(first[m], 12))
        if options:
            if len(chosen) > 1:
                last = chosen[-1]
                out = [[*x[:-1], x[-1] and x[1] != last] for x in out]
            out.append([0, options[0], families[options[0]], None, None, None, None, first[options[0]], True])
    spec = "step int, candidate string, family string, improvement double, top_change double, correlation double, diversity double, score double, chosen boolean"
    return frame.sparkSession.createDataFrame([tuple(x) for x in out], spec)


def _aligned(origins: list, strata: dict, e: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Per candidate: mean of the strata's WAPE by their weights, renormed over the strata with volume."""
    total, weight = np.zeros(e.shape[1]), 0.0
    for name, w in STRATA.items():
        here = [i for i, o in enumerate(origins) if strata[o] == name]
        if here and v[here].sum() > 0:
            total, weight = total + w * e[here].sum(axis=0) / v[here].sum(axis=0), weight + w
    return total / weight if weight else np.full(e.shape[1], np.nan)


def forward_groups(
    train: DataFrame, held: DataFrame, base: list[str], groups: dict[str, list[str]], alpha: float = 10.0, least: float = 0.002, tolerance: float = 0.03, half_lives: tuple[float, ...] = ()
) -> DataFrame:
    """round, label, groups, aligned, broad, bias_ratio, eligible, selected: forward selection of feature groups for a ridge on
    log residuals.

    train: origin, label, sample_weight and all columns (known numbers); held: origin, actual, target_baseline and all
    columns. One weighted Gram matrix of all columns gives every fit: a set of groups is a block of it. A round is one pass
    over `held`: all its options are columns of one product. Round 0 has the control (`base` only) and each group alone;
    the best goes on, and groups are added while the aligned WAPE falls by `least`. Then all groups together, and the
    winner at other half-lives of the training rows' weights (column `age`: days before the cutoff). Only options within
    `tolerance` of the control's broad WAPE can win.
    """
    columns = list(dict.fromkeys([*base, *[c for own in groups.values() for c in own]]))
    at = {c: i + 1 for i, c in enumerate(columns)}
    whole = lambda df: df.withColumn("__every", F.lit(0))
    matrix = lambda df: matrices(gram(whole(df), [*columns, "label"], "__every", "sample_weight"), "__every", len(columns) + 2).get(0)
    g = matrix(train)
    if g is None or not g[0, 0] > 0:
        raise ValueError("no training rows")
    rows = written(held.withColumn("__one", F.lit(1.0)))
    strata = {r.origin: r.s for r in rows.select("origin", stratum(F.col("origin")).alias("s")).distinct().collect()}  # a row an origin
    out: dict[str, dict] = {}

    def evaluate(options: dict[str, tuple], round_: int, of: np.ndarray = g) -> None:
        """Adds the options (label: groups) to `out` by one pass."""
        new = {k: v for k, v in options.items() if k not in out}
        if not new:
            return
        fits = [ridge(of, alpha, sorted({at[c] for c in [*base, *[x for name in own for x in groups[name]]]})) for own in new.values()]
        weights = np.array([[a, *c] for a, c in fits])
        origins, s = _by_origin(error_sums(rows, ["__one", *columns], weights, ["origin"], base="target_baseline"), len(weights))
        aligned, v = _aligned(origins, strata, s["e"], s["v"]), s["v"].sum(axis=0)
        for i, (label, own) in enumerate(new.items()):
            out[label] = {"round": round_, "groups": own, "aligned": float(aligned[i]), "broad": float(s["e"][:, i].sum() / v[i]), "bias_ratio": float(s["b"][:, i].sum() / v[i])}

    def best(labels: list[str]) -> str:
        limit = out["control"]["broad"] * (1 + tolerance)
        fits = [x for x in labels if np.isfinite(out[x]["aligned"]) and out[x]["broad"] <= limit]
        return min(fits, key=lambda x: (round(out[x]["aligned"], 12), round(abs(out[x]["bias_ratio"]), 12), labels.index(x))) if fits else "control"

    names = list(groups)
    evaluate({"control": (), **{f"single_{n}": (n,) for n in names}}, 0)
    current, round_ = best(["control", *[f"single_{n}" for n in names]]), 1
    while len(out[current]["groups"]) < len(names):
        have = out[current]["groups"]
        options = {f"forward_{round_}_{'+'.join(sorted((*have, n)))}": tuple(sorted((*have, n))) for n in names if n not in have}
        evaluate(options, round_)
        found = best([current, *options])
        if found == current or out[found]["aligned"] > out[current]["aligned"] * (1 - least):
            break
        current, round_ = found, round_ + 1
    evaluate({"all_groups": tuple(names)}, round_)
    winner = best(["control", current, "all_groups"])
    tried = [winner]
    for h in half_lives:
        label = f"half_life_{h:g}"
        evaluate({label: out[winner]["groups"]}, round_ + 1, matrix(train.withColumn("sample_weight", F.pow(F.lit(2.0), -F.col("age") / float(h)))))
        tried.append(label)
    selected, limit = best(tried), out["control"]["broad"] * (1 + tolerance)
    made = [(x["round"], k, "+".join(x["groups"]), x["aligned"], x["broad"], x["bias_ratio"], x["broad"] <= limit, k == selected) for k, x in out.items()]
    return train.sparkSession.createDataFrame(made, "round int, label string, groups string, aligned double, broad double, bias_ratio double, eligible boolean, selected boolean")
