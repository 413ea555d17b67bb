"""The repeated-passage removal against a brute-force reading of its definition."""

import random

import pytest

from quayside.llm import suffix_dedup
from quayside.llm.suffix_array import suffix_array

DOC = "doc_id long, text string, n_chars long"


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[doc] = (len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), bytes(c for c, g in zip(raw, gone) if not g))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(4)]
    base = [" ".join(word() for _ in range(r.randint(1, 150))) for _ in range(8)]
    out = [None, "", "x" * 99, "ab" * 300, "ab" * 301, "z" * 100, "z" * 400]
    for _ in range(n):
        kind = r.random()
        t = r.choice(base).split(" ")
        if kind < 0.5:
            t[r.randrange(len(t))] = word()
        if kind > 0.3:
            at = r.randrange(len(t) + 1)
            t[at:at] = [r.choice(passages)]
        out.append(" ".join(t))
    r.shuffle(out)
    return list(enumerate(out))


def test_suffix_array():
    r = random.Random(1)
    for _ in range(2000):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 25))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("apart", [2000, 1])
def test_against_brute_force(spark, monkeypatch, apart):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", apart)
    rows = texts(3)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], DOC).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == brute(rows)
    assert sum(x[1] for x in got.values()) > 1000


def test_edges(spark):
    t = " ".join(str(i) for i in range(60))
    rows = [(1, t, 0), (1, t, 0), (2, t + "!", 0), (None, t, 0)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 0), (1, 0), (2, len(t))]
    assert suffix_dedup.deduplicate(spark.createDataFrame([], DOC)).count() == 0
