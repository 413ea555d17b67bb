"""Measures, modified Kneser-Ney probabilities and bands against plain readings."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quayside.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


class KneserNey:
    """One language, by dictionaries and recursion."""

    def __init__(self, texts, order=5):
        self.order = order
        self.c = {order: Counter(g for t in texts for g in self.grams(t))}
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.after = {}, {}
        for k, c in self.c.items():
            n = [sum(v == j for v in c.values()) for j in range(5)]
            self.d[k] = [0.0]
            for i in (1, 2, 3):
                sane = n[1] and n[2] and n[i]
                self.d[k].append(min(max(i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i], 0.0), i) if sane else i / 2)
            self.after[k] = defaultdict(list)
            for g, v in c.items():
                self.after[k][g[:-1]].append(v)

    def grams(self, text):
        t = quality.text_bytes(text.encode())
        return [t[i : i + self.order] for i in range(len(t) - self.order + 1)]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / 256
        own = self.after[k].get(g[:-1])
        if own is None:
            return self.p(g[1:])
        cut = lambda v: self.d[k][min(v, 3)]
        c = self.c[k].get(g, 0)
        return (max(c - cut(c), 0) + sum(map(cut, own)) * self.p(g[1:])) / sum(own)

    def log_perplexity(self, text):
        own = self.grams(text)
        return -sum(math.log10(self.p(g)) for g in own) / len(own)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b", "a a a a", "a b c a b c", "x\x0by é ß#$", "l 1\nl 1\n l 1\n\nl 1\r\nl 1\r", "a b c d a b c x a b", " a  b"])
def test_measures(text):
    assert quality.measures(text.encode()) == measures(text)


def test_measures_of_random_texts():
    rng = random.Random(2)
    for n in (3, 10, 200):
        text = "".join(rng.choice(["a", "b", "é", "|"]) + rng.choice([" ", "\n", "\t", "\x0c", "  "]) for _ in range(n))
        assert quality.measures(text.encode()) == measures(text)


def texts(rng, n, letters):
    return [" ".join("".join(rng.choices(letters, k=rng.choice([1, 2, 3, 6]))) for _ in range(rng.choice([1, 20, 60, 90]))) for _ in range(n)]


@pytest.fixture
def docs():
    rng = random.Random(5)
    rows = [(i, t, "en") for i, t in enumerate(texts(rng, 60, "abcde "))] + [(100 + i, t, None) for i, t in enumerate(texts(rng, 60, "éüx"))]
    return rows + [(5, rows[6][1], "en"), (None, rows[7][1], "en"), (300, None, "en"), (301, "", "de"), (302, "Z" * 50_000, "en"), (303, " ".join(["same"] * 80), "de"), (304, "語" * 70 + " b" * 60, "ja")]


def test_judges_as_a_plain_reading_does(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "BUCKET", 300)
    monkeypatch.setattr(quality, "PASSED_ON", 500)
    monkeypatch.setattr(quality, "ASKING", 100)
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, lang string, low int, kept string").repartition(3)
    got = quality.judge(df, block_bytes=3000).collect()
    assert len(got) == len(docs)
    by_lang = defaultdict(list)
    for _, t, lang in docs:
        by_lang[lang].append(t or "")
    models = {lang: KneserNey(own) for lang, own in by_lang.items()}
    want = Counter()
    for i, t, lang in docs:
        n = measures(t or "")
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        want[(i, *n, failed, lang, round(models[lang].log_perplexity(t or ""), 3))] += 1
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.lang, round(r.log_perplexity, 3)) for r in got)
    assert sum((want - have).values()) <= 5 and sum(have.values()) == sum(want.values())  # some may round the other way
    # bands
    passed = defaultdict(list)
    for r in got:
        if not r.base_failed:
            passed[r.lang].append(round(r.log_perplexity / 0.001))
    every = [x for own in passed.values() for x in own]

    def band(xs):
        middle = lambda v: sorted(v)[(len(v) - 1) // 2]
        m = middle(xs)
        down, up = (max(1.4826 * middle([abs(x - m) for x in xs if keep(x)]), 10) for keep in (lambda x: x <= m, lambda x: x >= m))
        return (m - 6 * down) * 0.001, (m + 6 * up) * 0.001

    for r in got:
        if not r.base_failed:
            low, high = band(passed[r.lang] if len(passed[r.lang]) >= 50 else every)
            assert (r.low, r.high) == (pytest.approx(low), pytest.approx(high))
            assert r.kept == (low <= r.log_perplexity <= high)
        else:
            assert not r.kept


def test_unseen_ngrams_back_off(spark):
    """Texts that the model was not learned from."""
    rng = random.Random(8)
    known, new = texts(rng, 40, "abc"), texts(rng, 10, "abxy")
    frame = lambda own: spark.createDataFrame([(i, t, "en") for i, t in enumerate(own)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.log_perplexity for r in quality.score(frame(new), quality.learn(frame(known)), 700).collect()}
    model = KneserNey(known)
    assert got == {i: pytest.approx(model.log_perplexity(t), abs=1e-4) for i, t in enumerate(new)}


def test_mixing_is_invertible():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (quality.plain(quality.mixed(keys)) == keys).all()


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
