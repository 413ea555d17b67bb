"""Ranked search against a plain reading of its formula."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quayside.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n, total = len(own), sum(x[2] for x in own)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in own:
            s, m = 0, 100 - 25 + (25 * length * n) // total
            for t in terms(text):
                if c[t]:
                    df = sum(t in x[1] for x in own)
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


DOCS = "doc_id long, text string, score string, item string"


@pytest.fixture
def small(monkeypatch):
    """Few documents a block, so that scores are carried between blocks and bands."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    monkeypatch.setattr(lexical, "GATHER_DOCS", 40)


def test_ranks_as_the_formula_says(spark, small):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "naïve", "语言"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice([1, 3, 10, 40, 400])))) for i in range(150)]
    docs += [(7, docs[3][1]), (None, docs[4][1]), (500, None), (501, ""), (502, "... --- !!!"), (503, "X" * 100_000 + " w1 W1"), *[(600 + i, "w1 w2 w3 copy") for i in range(60)]]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30])))) for i in range(12)] + [(50, None), (51, "?!"), (52, "unknown"), (53, "copy W1 w1"), (53, "w5"), (None, "w9 w9")]
    got = lexical.rank(spark.createDataFrame([(i, t, "s", "x") for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"))
    assert rows(got) == sorted(brute(docs, items), key=str)


def test_every_pile_of_items_is_ranked(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PILE_BYTES", 200)
    docs, items = [(i, f"a{i % 5} b{i % 3} c") for i in range(30)], [(i, f"a{i % 5} c") for i in range(11)]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert rows(got) == sorted(brute(docs, items, 4), key=str)


def test_empty_tables_give_no_rows(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(none, items).collect() == []
    assert lexical.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []


def test_bounds_hold_and_leave_documents_out():
    rng = random.Random(1)
    words = [f"w{j}".encode() for j in range(300)]
    docs = [(i, 30, Counter(rng.choices(words, k=30))) for i in range(400)]
    names = ["doc_ids", "lengths", "words", "sizes", "terms", "counts", "width", "slices", "n_docs", "n_terms"]
    block = lexical.Block(dict(zip(names, lexical._block(docs))))
    maps = block.held(lexical.hashed(words))
    real = block.counts(np.arange(400), block.found(words))
    may = np.unpackbits(maps, axis=2, count=400)
    for level, least in enumerate(lexical.FROM):
        assert (may[level].T >= (real >= least)).all()  # never too few
    assert may[0].sum() < 1.5 * (real > 0).sum()
    best = [lexical.Best(5, 1)]
    n = lexical.search_block(block, [[(3, 5000), (8, 4000), (200, 6000)]], lexical.hashed(words), block.found(words), 400, 400 * 30, best)
    assert 5 <= n < 200
