"""The lexicon against a plain reading of its rule, and columns that clash."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayside.llm import suffix_dedup, toxicity


def corpus(spark, n_toxic=1500, n_clean=3000, rare=30):
    rng = random.Random(11)
    usual = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n_toxic + n_clean):
        own = rng.choices(usual, k=20)
        if i < n_toxic:
            own[3] = rng.choice(["vilelum", "scorbut", "grumpet"])
            if i < rare:
                own[7] = "zorblat"
        rows.append((i, " ".join(own), int(i < n_toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    return rows, docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")


def test_lexicon_as_a_plain_reading_has_it(spark):
    rows, docs, labels = corpus(spark)
    model = toxicity.learn(docs, labels)
    toxic, clean = Counter(), Counter()
    for _, t, x in rows:
        (toxic if x else clean).update(toxicity.entries(toxicity.fold(t)))
    nt, nc = 1500, 3000
    cands = {e: k for e, k in toxic.items() if k >= 3}
    least, share, want = 2 * math.log(len(cands) + 1) + 4.0, nt / (nt + nc), {}
    for e, k in cands.items():
        c = clean.get(e, 0)
        w = math.log((k + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
        g = 2 * (k * math.log(k / (k + c) / share) + (c * math.log(c / (k + c) / (1 - share)) if c else 0))
        if w >= 2.0 and g >= least:
            want[e] = round(w, 6)
    want = {e: w for e, w in want.items() if not any(e[: n + 1] != e and want.get(e[: n + 1], -1) >= w for n in range(4, 9))}
    assert dict(model.lexicon) == pytest.approx(want) and any("zorb" in e for e in want)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    a = toxicity.automaton(model.lexicon, model.exceptions)
    for i, t, x in rows[::97]:
        f = toxicity.features(t, a)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(p * q for p, q in zip(f, model.weights)) + model.weights[-1]))))


def test_a_word_of_few_toxic_texts_is_learned(spark):
    """30 of 20,000 toxic rows have it, and no clean one."""
    n = 20_000
    text = F.when(F.col("id") < 30, F.concat_ws(" ", F.lit("zorblat"), (F.col("id") % 97).cast("string"))).otherwise(F.concat_ws(" ", F.lit("alpha beta"), (F.col("id") % 97).cast("string")))
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") < n).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels)
    assert any("zorb" in e for e, _ in model.lexicon)
    new = spark.createDataFrame([(1, "zorblat 5"), (2, "alpha beta 5")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert got[1] > 0.5 > got[2] - 0.2


def test_clashing_columns_stay(spark):
    _, docs, labels = corpus(spark, 60, 120)
    model = toxicity.learn(docs, labels)
    own = docs.limit(5).withColumns({"f": F.lit("mine"), "__features": F.lit(3)})
    got = toxicity.scored(own, model)
    assert got.columns == [*own.columns, "score"] and {r.f for r in got.collect()} == {"mine"}
    with pytest.raises(ValueError):
        toxicity.scored(own.withColumn("score", F.lit(1)), model)
    assert "toxicity" in toxicity.scored(own.withColumn("score", F.lit(1)), model, "toxicity").columns
    with pytest.raises(ValueError):
        suffix_dedup.deduplicate(docs.withColumn("kept", F.lit(1)), carry=("kept",))


def test_the_largest_of_several_labels_counts_and_edges(spark):
    _, docs, labels = corpus(spark, 200, 400)
    twice = labels.unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0)))
    assert toxicity.learn(docs, twice).lexicon == toxicity.learn(docs, labels).lexicon
    assert toxicity.learn(docs.limit(0), labels).lexicon == ()
    model = toxicity.learn(docs, labels)
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "scorbut " * 50_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.score) for r in toxicity.score(rows, model).collect())
    assert len(got) == 4 and got[0][1] == got[1][1] == got[2][1] < 0.5 < got[3][1]
