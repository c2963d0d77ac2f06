import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rollmill.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", " ", "  \n\n x", "Hello, world! it's 2025", "a" * 5000, "é̂ \x00 ﻿", "💥💥 数学", "<|endoftext|> a", "tab\tand\r\nline", "ﬁ №5 ½", "don't DON'T 'll"]


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.DEFAULT_VOCABULARY)


def test_same_as_the_tokenizer(own):
    theirs = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    theirs.encode_special_tokens = True
    for text in TEXTS:
        assert list(own.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, text


def test_round_trip(own):
    for text in TEXTS:
        assert own.decode(own.encode(text)) == text


def test_memory_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    fresh = bpe.ByteBpe()
    words = "one two three four five six seven"
    assert list(fresh.encode(words)) == list(own.encode(words))
    assert len(fresh) <= 3


def test_corpus_with_nulls_repeats_and_extra_columns(spark):
    rows = [Row(doc_id=1, text=None, key="x", ids=5), Row(doc_id=2, text="", key=None, ids=5), Row(doc_id=3, text="two words", key="y", ids=None), Row(doc_id=3, text="two words", key="y", ids=None), Row(doc_id=None, text="z", key="", ids=1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    out = bpe.encode_corpus(docs)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = sorted((r.doc_id or 0, r.ids) for r in out.collect())
    assert [k for k, _ in got] == [0, 1, 2, 3, 3] and got[1][1] == got[2][1] == [] and got[3] == got[4]
    back = out.where("doc_id = 3").select(bpe.decode_column(F.col("ids")).alias("t")).first().t
    assert back == "two words"
    assert [r.n for r in docs.orderBy("doc_id").select(bpe.token_count(F.col("text")).alias("n")).collect()] == [1, 0, 0, 2, 2]


def test_empty_table(spark):
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
