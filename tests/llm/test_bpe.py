"""Long fragments, special strings and batches of the encoder, against the tokenizers library."""

import random

import pytest

from quayside.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(queries.vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def _same(own, library, texts):
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_long_words_and_fragments(library):
    own, r = bpe.ForcedBoundaryBpe(queries.vocabulary()), random.Random(3)
    _same(own, library, ["".join(r.choice(letters) for _ in range(n)) for letters in ("etaoinshr", "abcdefghijklmnopqrstuvwxyz", "aab") for n in (1, 2, 31, 32, 33, 34, 64, 65, 300, 5000)])
    assert max(map(len, own.memo)) <= bpe.SHORT


def test_a_word_of_a_million_letters_costs_little_more_than_its_parts():
    own, r = bpe.ForcedBoundaryBpe(queries.vocabulary()), random.Random(4)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert 200_000 < len(own.encode(word)) < 1_000_000


def test_random_texts_and_special_strings(library):
    own, r = bpe.ForcedBoundaryBpe(queries.vocabulary()), random.Random(5)
    odd = ["".join(r.choice("abcdefghij éß中0 \n\t'’Σ\U0001f600-_<|") for _ in range(r.randrange(120))) for _ in range(2000)]
    _same(own, library, [*odd, "", " ", "<|endoftext|>x<|startoftext|>", "<|", "<|endoftext|", "a<|endoftext|>", "can't we'll I'M"])


def test_a_full_memory_is_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.ForcedBoundaryBpe(queries.vocabulary())
    for text in ("one two three four", "five six seven", "one two three four five six seven eight"):
        _same(own, library, [text])


def test_no_rows_and_rows_without_text(spark):
    schema = "doc_id long, text string, ids string"
    empty = spark.createDataFrame([], schema)
    assert bpe.round_trip_digests(empty, queries.vocabulary()).count() == 0
    rows = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a", None), (2, "a", "y"), (2, "a", "y")], schema)
    assert sorted(r.n_tokens for r in bpe.round_trip_digests(rows, queries.vocabulary()).collect()) == [0, 0, 1, 1, 1]
