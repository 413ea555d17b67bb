"""The pipeline's stages on null and repeated doc_ids: each row is judged by its own text."""

import corpus_pipeline
from quayside.llm import toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], DOC)


def test_toxic_rows_go_alone(spark, monkeypatch):
    model = toxicity.Model(((" idiot ", 5.0),), (), (0.0, 2.0, 0.0, 0.0, -4.0))
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: model)
    rows = [(None, "you idiot you"), (None, "a clean text"), (None, None), (1, "what an idiot says"), (1, "a clean text"), (2, "clean"), (2, "clean")]
    out = corpus_pipeline.reject_toxic(spark, docs_of(spark, rows), "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, ""), (0, "a clean text"), (1, "a clean text"), (2, "clean"), (2, "clean")]


def test_one_doc_id_of_several_texts(spark):
    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " z"), (3, texts[2])]
    out = corpus_pipeline.one_of_near_duplicates(spark, docs_of(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, texts[0]), (1, texts[1]), (3, texts[2])]


def test_cut_text_stays_on_its_row(spark):
    t = " ".join(str(i) for i in range(60))
    rows = [(1, t), (2, t + "!one"), (2, t + "!one"), (2, t + "?another text"), (3, None), (None, t)]
    out = corpus_pipeline.cut_repeats(spark, docs_of(spark, rows), "").collect()
    got = sorted((r.doc_id or 0, r.text if r.text is None else r.text.replace(t, "T"), r.n_chars) for r in out)
    assert got == [(0, "T", len(t)), (1, "T", len(t)), (2, "!one", 4), (2, "!one", 4), (2, "?another text", 13), (3, None, None)]
