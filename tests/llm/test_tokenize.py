import os

import pytest

from lattica.llm import tokenize
from lattica.llm.tokenize import Vocabulary, blocks, counted, decoded, encoded

FOLDER = os.environ.get("LATTICA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = Vocabulary(f"{FOLDER}/byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY.path), reason="no tokenizer files")

TEXTS = [
    "Hello world, it's 2024!", "", None, "   ", "a\r\n\n  b\t c ", "<|endoftext|> is text", "ÄÖ ß 回路は遅延 　x", "👩🏽‍🔬✨", "x" * 50_000,
    "word " * 20_000, "\x00\x01", "don't we'll", " leading", "Hello world, it's 2024!",
]


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' as words", "'c' as block", "1 as slot")


def test_ids_equal_the_library(spark, monkeypatch):
    for size in (tokenize.BLOCK_CHARS, 100):
        monkeypatch.setattr(tokenize, "BLOCK_CHARS", size)
        got = {r.doc_id: list(r.ids) for r in encoded(frame(spark).repartition(3), vocabulary=VOCABULARY).collect()}
        assert [got[i] for i in range(len(TEXTS))] == expected(TEXTS)


def test_small_blocks(spark):
    made = blocks(frame(spark).coalesce(1), "doc_id", "text", block_chars=10).select("block").distinct().count()
    assert made > 5


def test_round_trip_and_counts(spark, collect):
    ids = encoded(frame(spark), vocabulary=VOCABULARY)
    assert collect(decoded(ids, vocabulary=VOCABULARY)) == sorted([(i, t or "") for i, t in enumerate(TEXTS)], key=repr)
    assert collect(counted(frame(spark), vocabulary=VOCABULARY)) == sorted(((i, len(x)) for i, x in enumerate(expected(TEXTS))), key=repr)


def test_empty_table_null_and_repeated_ids(spark, collect):
    assert collect(encoded(frame(spark).limit(0), vocabulary=VOCABULARY)) == []
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert collect(encoded(df, vocabulary=VOCABULARY).selectExpr("doc_id", "size(ids)")) == sorted([(None, 1), (1, 1), (1, 1)], key=repr)
