"""Values of any size, repeated ids, empty tables and long words, each against a plain reading of the definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import embed_dedup, simhash, topk, toxicity
from quayside.llm.vectors import unit

VEC = "vec_id long, embedding array<double>, label string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b") for i, v in rows], VEC)


def brute_top(rows, k=10):
    """Every query's row against all rows but those of its own vec_id."""
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            s = sorted((-max(topk.LEAST, min(topk.MOST, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a))
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("size", [1.0, 1e6, 1e9, 2.0**52, 1e18, 1e300])
def test_topk_of_any_size(spark, size):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) * size for _ in range(4)]) for i in range(90, 130)]
    rows += [(131, None), (132, []), (133, [1.0, None, 2.0, 3.0]), (134, [math.inf, 0, 0, 0]), (135, [1.0, 2.0]), (None, [1.0] * 4), (200, [0.0] * 4), (101, rows[0][1])]
    df = vectors(spark, rows)
    got = topk.top_k(df, df.where(F.col("vec_id") % 100 == 0))
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows)


def test_topk_in_many_blocks_and_turns(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 7)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "PILE_BYTES", 200)
    r = random.Random(4)
    rows = [(i * 20, [r.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    df = vectors(spark, rows)
    got = topk.top_k(df, df.where(F.col("vec_id") % 100 == 0))
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def brute_links(rows, at=0.95):
    def cosine(a, b):
        m, n = max(map(abs, a)), max(map(abs, b))
        x, y = np.array(a) / m, np.array(b) / n
        return float(x @ y / math.sqrt((x @ x) * (y @ y)))

    ok = [i for i, (_, v) in enumerate(rows) if v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    near = {i: [j for j in ok if j != i and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= at] for i in ok}
    return [len(near.get(i, ())) for i in range(len(rows))]


def test_embeddings_of_any_size(spark):
    rows = [(1, [1e200] * 4), (2, [2e200] * 4), (3, [1e-200, 9e-200, 0, 0]), (4, [9e-200, 1e-200, 0, 0]), (5, [5e-324, 0, 0, 0]), (6, [1e300, 0, 0, 0]), (7, None), (8, [0.0] * 4), (9, [-0.0, 1.0, 0, 0]), (10, [0.0, 3.0, 0, 0]), (10, [0.0, 3.0, 0, 0]), (11, [math.nan, 1, 1, 1]), (12, [])]
    got = embed_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted(zip([i for i, _ in rows], brute_links(rows)))
    of = {r.vec_id: r.component_id for r in got}
    assert (of[2], of[6], of[5], of[10], of[9], of[3], of[4]) == (1, 4, 4, 3, 3, 3, 4)
    assert embed_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("dims", [8, 64, 256])
def test_recall_of_cells(dims):
    """Pairs at a given cosine that meet in a cell: the index's recall, of 2,000 pairs each."""
    r = np.random.default_rng(dims)
    a = unit(r.standard_normal((2000, dims)))
    side = r.standard_normal((2000, dims))
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    for cosine, least in ((0.951, 0.97), (0.97, 0.99), (0.99, 0.999)):
        b = cosine * a + math.sqrt(1 - cosine**2) * side
        x, y = embed_dedup.cells(a), embed_dedup.cells(b)
        met = np.array([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist())])
        assert met.mean() >= least, (cosine, met.mean())


def test_toxicity_matches_against_search():
    r = random.Random(5)
    lexicon = ((" scum ", 5.0), (" scum", 2.0), (" idio", 3.0), (" idiot ", 4.0), (" trash ", 2.5), (" " + "x" * 41 + " ", 6.0))
    spared = ("pond scum", "trash can", "trash can trash bin")
    a = toxicity.automaton(lexicon, spared)
    words = ["scum", "scums", "pond", "idiot", "idiotic", "trash", "can", "bin", "ok", "x" * 41]
    for _ in range(300):
        folded = toxicity.fold(" ".join(r.choices(words, k=r.randrange(0, 30))))
        covered = {i for p in spared for i in range(len(folded)) if folded.startswith(f" {p} ", i) for i in range(i, i + len(p) + 1)}
        want = []
        for i in range(len(folded)):
            best = max((w for e, w in lexicon if folded.startswith(e, i)), default=0)
            if best and i not in covered:
                want.append(best)
        assert sorted(toxicity.matches(folded, a)) == sorted(want), folded


def test_a_long_word_can_be_toxic(spark):
    slur = "q" * 60 + "z"
    rows = [(i, f"hello {slur} there {i}" if i % 2 else f"hello there {i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(x) for i, _, x in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_simhash_of_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
