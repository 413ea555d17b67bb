"""The registered queries on small tables against brute-force readings of their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quayside.llm import bpe, chat, embed_dedup, licenses, lm, packing, queries, simhash, topk, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, part long"


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return dict(zip(t.doc_id.tolist(), t.text.tolist()))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    rows = [(None, None, None, None, None, 1, 1), (1, "", "en", "a", 0, 1, 1), (2, "x " * 30_000, None, "a", 1, 1, 1), (3, "All rights reserved. cc by", "en", None, 5, None, 1), (3, "All rights reserved. cc by", "en", None, 5, None, 1), (4, "you idiot <|endoftext|> \\ <|im_end|>", "en", "b", 9, 2, None)]
    return spark.createDataFrame(rows, DOC)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


ODD_TEXTS = ["", "İstanbul ΣΑΣ ΌΣ. x", "<|endoftext|>a <|startoftext|>", "ab\x1ccd ² ½ Ⅷ 漢字​ é 'S I'LL don't \x85   z", "🙂🙂 a b __ _a é", "\x00\x7f"]


def test_bpe_against_library(spark, texts):
    t = library()
    own = bpe.tokenizer(queries.vocabulary())
    for x in [*texts.values(), *ODD_TEXTS]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x).tolist() == ids
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    for r in queries.op1_bpe(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(odd):
    out = bpe.decode(bpe.encode(odd, queries.vocabulary()), queries.vocabulary()).collect()
    assert len(out) == 6 and {"ids", "decoded", "row", "part"} <= set(out[0].asDict())


def test_packing(spark, texts):
    t = library()
    rows = [r.asDict() for r in queries.op5_packing(spark, SF).collect()]
    for doc, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq, pieces in by.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 2048 or seq == max(by)


def test_packing_edges(spark, odd):
    out = packing.pack(odd, queries.vocabulary(), 100, with_ids=True).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)
    assert sum(r.start == 0 for r in out) == 6
    assert packing.pack(odd.where("false"), queries.vocabulary()).count() == 0


def fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0


def classes(keys, linked):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("block", [256, 3])
def test_simhash(spark, texts, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fp = {d: fingerprint(t) for d, t in texts.items()}
    want = classes(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SF).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_simhash_chains(spark):
    import random

    r = random.Random(5)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            for _ in range(r.choice([1, 2, 3, 3, 4, 6])):
                x ^= 1 << r.randrange(64)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    u = [x & (2**64 - 1) for x in fps]
    pairs = [(i, j) for i in range(len(u)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 3]
    found = [(fps.index(x.a), fps.index(x.b)) for x in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert set(map(frozenset, found)) <= set(map(frozenset, pairs))
    assert classes(range(len(u)), found) == classes(range(len(u)), pairs)


def test_simhash_edges(spark, odd):
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert len(got) == 6 and got[0][1] == "0" * 16 and got[1][2] == 1
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_topk(spark):
    import pyarrow.parquet as pq

    e = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    v = np.floor(np.stack(e.embedding.values).astype(float) * 1024).astype(np.int64)
    ids = e.vec_id.to_numpy()
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        s = v @ v[i]
        top = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        want |= {(ids[i], n + 1, ids[j], s[j]) for n, j in enumerate(top)}
    assert {tuple(r) for r in queries.op7_topk(spark, SF).collect()} == want


@pytest.mark.parametrize("blocks", [(8192, 256), (7, 2)])
def test_topk_small(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "ROWS", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = np.random.default_rng(1)
    v = np.r_[rng.standard_normal((60, 5)) * rng.choice([0.01, 1, 50], (60, 1)), np.zeros((3, 5)), np.ones((4, 5))]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [math.nan] * 5), (503, [math.inf] * 5), (504, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", df_lit())
    q = np.floor(v * 1024).astype(np.int64)
    want = set()
    for i in range(0, 67, 5):
        s = q @ q[i]
        top = [j for j in np.lexsort((np.arange(67), -s)) if j != i][:10]
        want |= {(i, n + 1, int(j), int(s[j])) for n, j in enumerate(top)}
    assert {tuple(r) for r in topk.top_k(df, df.where("vec_id % 5 = 0")).collect()} == want
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 1")).count() == 2
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


@pytest.mark.parametrize("together", [512, 4])
def test_embedding_dedup(spark, monkeypatch, together):
    monkeypatch.setattr(embed_dedup, "TOGETHER", together)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    v = np.concatenate([base, base[:10] + rng.standard_normal((10, 16)) * 0.1, np.repeat(base[:1], 12, 0) + rng.standard_normal((12, 16)) * 0.05, base[3:5], base[6:7] * 3])
    bad = [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [None] * 16), (None, None)]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want = classes(range(len(v)), zip(*np.nonzero(close)))
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()
    got = {r.vec_id: tuple(r)[1:] for r in out}
    assert len(out) == len(rows) + 5
    assert {k: got[k] for k in range(len(v))} == {k: (int(close[k].sum()), want[k], k == want[k]) for k in range(len(v))}
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903))


def test_e8():
    roots = embed_dedup.e8_roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots**2).sum(1), 2)
    x = np.random.default_rng(0).standard_normal((500, 8))
    p = embed_dedup.e8_nearest(x)
    d = ((x - p) ** 2).sum(1)
    assert all((((x - p - r) ** 2).sum(1) >= d - 1e-9).all() for r in roots)
    assert np.allclose(p * 2, np.rint(p * 2)) and (np.rint(p.sum(1)) % 2 == 0).all()


def scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for p, label in licenses.PHRASES.items():
        p = p.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    more = set(labels)
    for label, t in licenses.TEMPLATES:
        t = re.findall("[a-z0-9]+", t.lower())
        size, t = -(-3 * len(t) // 2), set(t)
        if any(x in t and len(set(w[i : i + size]) & t) / len(t) >= 0.8 for i, x in enumerate(w)):
            more.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(more))


EXTRA = ["CC BY cc BY-cc by, CC-by", "All RIGHTS reserved all rights reserved", "K cc by", "general PUBLIC\nlicense", "MIT license released under it", "cc\x80by ccéby", "cc  by", "released the MIT license\nunder", "this work is licensed gnu general public license version"]


def test_licenses(spark, texts, odd):
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op9_licenses(spark, SF).collect()}
    assert got == {d: scan(t) for d, t in texts.items()}
    df = spark.createDataFrame(list(enumerate(EXTRA)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:7] for r in licenses.scan(df).collect()} == {d: scan(t) for d, t in enumerate(EXTRA)}
    out = licenses.scan(odd).collect()
    assert len(out) == 6 and sorted(r.n_base for r in out) == [0, 0, 0, 0, 2, 2] and all(0 <= r.score <= 1 for r in out)


def test_lm(spark, texts):
    def toks(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]

    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, t in texts.items() if not held[d] for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op4_lm_score(spark, SF).collect()}
    for d, t in texts.items():
        w, r = toks(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    out = [r for d, r in got.items() if held[d]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_edges(spark, odd):
    from pyspark.sql import functions as F

    out = lm.score(odd.withColumn("train", F.lit(True))).collect()
    assert len(out) == 6 and all(math.isfinite(r.score) for r in out)
    assert lm.score(odd.withColumn("train", F.lit(False))).count() == 6
    assert lm.score(odd.where("false").withColumn("train", F.lit(True))).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in out)
    assert hit / max(1, sum(r.predicted for r in out)) > 0.8
    assert hit / sum(labels[r.doc_id] for r in out) > 0.6


def test_toxicity_folds():
    assert toxicity.fold("1D10T, іdiоt! scu$m ｓcum").split() == ["idiot", "idiot", "scusm", "scum"]
    a = toxicity.automaton((("  clown "[1:], 3.0), (" idio", 2.0), (" idiot ", 5.0)), ("clown fish",))
    assert toxicity.matches(toxicity.fold("a clown fish"), a) == []
    assert sorted(toxicity.matches(toxicity.fold("clown idiots IDIOT"), a)) == [2.0, 3.0, 5.0]


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(4, 1), (2, 0), (None, 1), (1, None), (3, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, toxicity.learn(odd, labels)).collect())
    empty = labels.where("false")
    assert toxicity.score(odd, toxicity.learn(odd, empty)).count() == 6


def test_chat_folding(spark):
    e = [(1, 1, "message", None, "user", "hi \\ <|im_end|>\n"), (1, 2, "message", None, "assistant", None), (1, 3, "delta", None, None, "a"), (1, 4, "delta", None, None, "b<|"), (1, 5, "edit", 1, None, "yo"), (1, 6, "regenerate", None, None, None), (1, 7, "delta", None, None, "c"), (1, 8, "nonsense", None, None, "x"), (None, 1, "delta", None, None, "x"), (2, None, "message", None, "a\nb\\n", "<|im_start|>")]
    out = chat.render(chat.reconstruct(spark.createDataFrame(e, "conv_id long, seq long, kind string, target long, role string, text string")))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parse(out.formatted)).withColumn("loss", chat.loss_texts(out.formatted, out.loss_spans)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "yo"), ("assistant", "c")] and got[1].loss == ["c"]
    assert got[None].turns == [] and [tuple(t) for t in got[2].turns] == [("a\nb\\n", "<|im_start|>")]
    r = {x.conv_id: x for x in queries.op3_chat(spark, SF).collect()}[-1]
    said = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    n = docs.count()
    assert 0 < n < 200
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({r.doc_id for r in out}) == n
