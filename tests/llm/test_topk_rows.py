"""Top-k where rows share a vec_id."""

import numpy as np

from quayside.llm import topk


def test_own_copies_take_no_place(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 6))
    v[:15] = 40.0  # fifteen rows of the query's vec_id, far above all others
    ids = np.r_[np.zeros(15, int), np.arange(1, 286)]
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>")
    q = np.floor(v * 1024).astype(np.int64)
    s = q @ q[0]
    top = [j for j in np.lexsort((ids, -s)) if ids[j] != 0][:10]
    want = [(0, n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(top)]
    got = topk.top_k(df, df.where("vec_id = 0").limit(1)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_rows_of_one_id_are_dealt_over_blocks(spark):
    df = spark.range(4000).selectExpr("7L vec_id", "array(id) v")
    dealt, blocks = topk._dealt(df, 400)
    counts = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert blocks == len(counts) == 10 and max(counts) < 600
