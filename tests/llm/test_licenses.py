"""Blocks across lines, whole license texts, the filters, and edges of the license scan."""

import random

from pyspark.sql import functions as F

from quayside.llm import licenses
from quayside.llm.license_texts import TEXTS

DOC = "doc_id long, text string, has string, label string"


def labels(spark, texts, **k):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC)
    return [r.labels for r in licenses.scan(df, **k).orderBy("doc_id").collect()]


def test_headers_wrapped_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
    assert labels(spark, [bsd, mpl, "Released under\n\nthe\tMIT - License."]) == ["bsd", "mpl-2.0", "mit"]


def test_whole_texts_and_edited_ones(spark):
    r = random.Random(1)
    texts = [t for _, t in TEXTS]
    edited = []
    for t in texts:
        w = t.split()
        for _ in range(len(w) // 20):
            w[r.randrange(len(w))] = "zzz"
        edited.append("# " + "\n# ".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7)))
    half = [" ".join(t.split()[: len(t.split()) // 3]) for t in texts]
    got = labels(spark, [*texts, *edited])
    for (label, _), a, b in zip(TEXTS, got, got[len(texts) :]):
        assert label in a.split(",") and label in b.split(",")
    plain = labels(spark, half, templates=TEXTS)
    assert all(label not in x.split(",") for (label, _), x in zip(TEXTS, plain))


def test_words_far_apart_are_no_notice(spark):
    far = "released " + "and " * 50 + "under " + "so " * 50 + "the mit " + "or " * 50 + "license"
    assert labels(spark, [far]) == [""]


def _prepared(spark, texts, templates=licenses.TEMPLATES, threshold=0.8):
    own = [licenses.Template(label, text, threshold) for label, text in templates]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("ws", licenses.words(F.lower("text"))).select("row", "ws")
    return rows, licenses.Index(own, licenses.word_counts(rows, own))


def brute(texts, templates, threshold=0.8):
    """Row, label and best containment, block by block."""
    out = {}
    for label, text in templates:
        t = licenses.Template(label, text, threshold)
        own = set(t.words)
        for i, x in enumerate(texts):
            ws = licenses._words_of(x)
            best = max((len(own & set(ws[j : j + t.block])) for j, w in enumerate(ws) if w in own), default=0)
            if best >= t.least:
                out[(i, label)] = max(out.get((i, label), 0), best / len(own))
    return out


def spread_texts(templates, r, ways=(1, 2, 3, 4, 6)):
    words = [w for _, t in templates for w in licenses._words_of(t)]
    return [" ".join(x for w in t.split() for x in (w, *r.choices(["qq", *words], k=r.randrange(k)))) for _, t in templates for k in ways]


def test_matches_equal_brute_force_and_filters_only_remove_what_cannot_match(spark):
    texts = spread_texts(licenses.TEMPLATES, random.Random(2)) + ["", "mit", "the " * 900 + licenses.TEXTS[0][1]]
    rows, index = _prepared(spark, texts)
    got = {(r.row, r.label): r.containment for r in licenses.template_matches(rows, index).collect()}
    assert got == brute(texts, licenses.TEMPLATES) and len(got) > 20
    found = licenses.stretches(rows, index)
    loose, tight = licenses.candidates(found, rows, index, positional=False), licenses.candidates(found, rows, index)
    assert found.count() >= loose.count() >= tight.count() > 0


def test_a_hundred_templates_by_the_same_plan(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    templates = tuple((f"t{i}", " ".join(r.choices(vocabulary, weights=[1 / (j + 1) for j in range(400)], k=r.choice([4, 9, 25, 60])))) for i in range(100))
    texts = spread_texts(templates[:25], r, (1, 2)) + [" ".join(r.choices(vocabulary, k=200)) for _ in range(20)]
    rows, index = _prepared(spark, texts, templates)
    matches = licenses.template_matches(rows, index)
    assert {(x.row, x.label): x.containment for x in matches.collect()} == brute(texts, templates)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plans = [licenses.scan(df, templates=own)._jdf.queryExecution().optimizedPlan().toString() for own in (templates[:3], templates)]
    assert plans[0].count("Relation ") == plans[1].count("Relation ") and plans[0].count("Union") == plans[1].count("Union") == 0


def test_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert licenses.scan(empty).count() == 0
    assert labels(spark, ["MIT License cc by"], templates=()) == ["cc-by"]
    rows = [(None, None, None, None), (1, "", "a", "b"), (1, "", "a", "b"), (2, "Licensed under CC BY-NC 4.0. " * 2000, "a", "b"), (3, "a" * 200_000, None, None)]
    out = sorted((r.doc_id or 0, r.n_words, r.labels) for r in licenses.scan(spark.createDataFrame(rows, DOC)).collect())
    # the last word of one sentence and the words of the next make other notices
    assert out[:3] == [(0, 0, ""), (1, 0, ""), (1, 0, "")] and out[4] == (3, 1, "")
    assert out[3][1] == 14_000 and {"cc-by", "cc-by-nc-4.0"} <= set(out[3][2].split(","))
