"""The backoff automaton against one that is built in memory and walked token by token."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import lm, queries

END = b" "


class Walker:
    """States, arcs and failure arcs as dictionaries."""

    def __init__(self, texts, order, mass):
        self.c, self.order, self.mass = Counter(), order, mass
        for t in texts:
            row = [END, *lm.tokens(t), END]
            for i in range(1, len(row)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        self.c[tuple(row[i - n + 1 : i + 1])] += 1
        words = {k: v for k, v in self.c.items() if len(k) == 1}
        self.n, self.v = sum(words.values()), len(words)

    def root(self, w):
        return (self.c[w,] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def arc(self, state, w):
        if not state:
            return self.root(w)
        m = self.mass[len(state) - 1]
        return (self.c[(*state, w)] + m * self.p(state[1:], w)) / (self.c[state] + m)

    def p(self, state, w):
        """Failure arcs until there is an arc."""
        weight = 1.0
        while state and not self.c[(*state, w)]:
            m = self.mass[len(state) - 1]
            weight *= m / (self.c[state] + m) if self.c[state] else 1.0
            state = state[1:]
        return weight * self.arc(state, w)

    def score(self, text):
        total, state = 0.0, (END,) if self.order > 1 else ()
        for w in [*lm.tokens(text), END]:
            while state and not self.c[state]:
                state = state[1:]
            total += math.log10(self.p(state, w))
            state = (*state, w)[1 - self.order :] if self.order > 1 else ()
        return total


def brute(rows, order=lm.ORDER, mass=lm.MASS):
    a = Walker([t for _, t, train in rows if train], order, mass)
    return a, [a.score(t) for _, t, _ in rows]


def _rows(n, seed=1):
    r = random.Random(seed)
    words = ["a", "b", "the", "The", "x1", "été", "longer-word", "z."]
    rows = [(i, " ".join(r.choices(words[: r.randrange(1, 9)], k=r.randrange(0, 40))).encode(), r.random() < 0.7) for i in range(n)]
    return [*rows, (n, rows[0][1], True), (n + 1, rows[0][1], False), (n + 2, b"never seen words", False), (n + 3, b"", True)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_bytes, bucket_bytes", [(1 << 20, 1 << 20), (400, 300)])
def test_blocks_and_buckets_change_nothing(spark, order, block_bytes, bucket_bytes):
    rows = _rows(60)
    a, want = brute(rows, order)
    df = spark.createDataFrame([(i, t.decode(), train) for i, t, train in rows], "doc_id long, text string, train boolean").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, order, block_bytes, bucket_bytes).collect()}
    assert len(got) == len(rows)
    for (i, t, _), s in zip(rows, want):
        assert got[i].score == pytest.approx(s) and got[i].train_tokens == a.n
        assert got[i].base_score == pytest.approx(sum(math.log10(a.root(w)) for w in [*lm.tokens(t), END]))


@pytest.mark.parametrize("fan_bits", [1, 2, 3])
def test_blocks_merged_in_rounds_change_nothing(spark, fan_bits):
    """Some 40 buckets: six rounds, three or two in place of one."""
    rows = _rows(120, seed=3)
    a, want = brute(rows)
    df = spark.createDataFrame([(i, t.decode(), train) for i, t, train in rows], "doc_id long, text string, train boolean").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, block_bytes=300, bucket_bytes=250, fan_bits=fan_bits).collect()}
    assert len(got) == len(rows)
    for (i, t, _), s in zip(rows, want):
        assert got[i].score == pytest.approx(s) and got[i].train_tokens == a.n
        assert got[i].n_known == sum(a.c[w,] > 0 for w in [*lm.tokens(t), END])


def test_a_block_has_no_more_rows_than_the_fan_allows(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(3000))
    blocks = lm._blocks(spark.createDataFrame([(1, text, True)], "doc_id long, text string, train boolean"), 1 << 20)
    rows = lm._passed_on(blocks, 3, 4).groupBy("order").count().collect()
    assert len(rows) == 3 and all(r["count"] <= 16 for r in rows)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("stretch", [1, 2, 7, 64])
def test_stretches_arrive_in_the_state_of_the_whole_walk(monkeypatch, order, stretch):
    monkeypatch.setattr(lm, "STRETCH", stretch)
    mass = (300.0, 100.0, 50.0)
    rows = _rows(40)
    g = lm.Grams([t for _, t, _ in rows], [train for _, _, train in rows], order)
    by, counts = g.unigrams()
    known = np.empty_like(counts)
    known[by] = counts
    a, want = brute(rows, order, mass)
    assert lm.Automaton(g, known, g.placed(), a.n, a.v, mass).walk() == pytest.approx(want)


def test_states_and_failure_arcs():
    """Learned: "a b" and "b a b". States: the end, a, b, and the pairs of them that were seen."""
    g = lm.Grams([b"a b", b"b a b"], [True, True], 3)
    by, counts = g.unigrams()
    known = np.empty_like(counts)
    known[by] = counts
    m = lm.Automaton(g, known, g.placed(), 7, 3)
    end, a, b = range(3)
    state = {(w,): int(m.root_to[w]) for w in (end, a, b)}
    assert sorted(state.values()) == [1, 2, 3] and not m.failure[:4].any()
    for u, w in [(end, a), (end, b), (a, b), (b, a), (b, end)]:
        to, _ = m.step(np.array([state[u,]]), np.array([w]))
        state[u, w] = int(to[0])
        assert m.failure[to[0]] == state[w,] and to[0] > 3
    assert len(m.failure) == 1 + 3 + 5
    # no arc for a after (end, a), nor after a: two failure arcs, then the root's
    to, p = m.step(np.array([state[end, a]]), np.array([a]))
    assert to[0] == state[a,] and p[0] == pytest.approx(math.log10(100 / 101 * 300 / 302 * 2.5 / 9))
    # an arc of the last order leads to the pair at its end
    assert m.step(np.array([state[end, b]]), np.array([a]))[0][0] == state[b, a]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, (r.text or "").encode(), zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs]
    _, want = brute(rows)
    got = {r.doc_id: r.score for r in queries.op4_lm_score(spark, "/root/testdata/sf0.001").collect()}
    for (i, _, _), s in zip(rows, want):
        assert got[i] == pytest.approx(s)


def test_every_state_gives_a_distribution():
    rows = _rows(20)
    a = Walker([t for _, t, train in rows if train], 3, lm.MASS)
    words = [k[0] for k in a.c if len(k) == 1]
    for state in [(), (END,), *[k for k in a.c if len(k) == 2 and k[-1] != END][:20]]:
        unseen = 0.5 / (a.n + 0.5 * (a.v + 1))
        left = math.prod(a.mass[n - 1] / (a.c[state[-n:]] + a.mass[n - 1]) for n in range(1, len(state) + 1))
        assert sum(a.p(state, w) for w in words) + left * unseen == pytest.approx(1)


def test_no_text_is_forgotten_however_rare(spark):
    rows = [(1, "one two three four five six", True), (2, "one two three four five six", False), (3, "six five four three two one", False)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    assert got[2].score > got[3].score and got[2].base_score == pytest.approx(got[3].base_score)


def test_packed_numbers_come_back():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        a = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm._unpacked(lm._packed(a)) == a).all() and (lm._widened(lm._squeezed(a[::-1])) == a[::-1]).all()


def test_a_text_of_one_long_word_and_a_very_long_text(spark):
    rows = [(1, "w" * 300_000, True), (2, "ab " * 300_000, True), (None, None, None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean").withColumn("ids", F.lit(1)), block_bytes=1000)
    got = {r.doc_id: r for r in got.collect()}
    assert [got[i].n_tokens for i in (1, 2, None)] == [2, 300_001, 1] and all(math.isfinite(r.score) for r in got.values())
