import pytest
from tokenizers import Tokenizer, models

from fleetfold.llm import token_counts
from fleetfold.llm.queries import op8_token_counts, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    scores = token_counts.vocabulary_scores(PATH)
    return Tokenizer(models.Unigram([("<unk>", min(scores.values())), *scores.items()], 0, True))


def expected(tokenizer, text):
    return len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0


def test_whole_table(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op8_token_counts(spark, sf_dir).collect()}
    assert got == {i: expected(tokenizer, t) for i, t in texts.items()}


def test_odd_texts(documents, tokenizer):
    texts = ["", " ", "  ", "a", " a", "a ", "a   b", "▁a ▁", "\n\n x\n", "漢字 \U0001f600\U0001f600 ñ", "<0x41>", "<unk> </s>", "\x00\x01",
             "supercalifragilistic" * 400, "e" * 3001, "    " * 50 + "x", "don't stop", "  ﻿"]
    df = documents(*enumerate(texts), (99, None), (99, None))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PATH).collect()}
    assert got == {i: expected(tokenizer, t) for i, t in enumerate(texts)} | {99: 0}


def test_ties_go_to_the_longer_piece():
    count = token_counts.viterbi_counter({"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "abc": -3.0})
    assert (count("ab"), count("abc"), count("abab"), count("ba"), count("é")) == (1, 1, 2, 2, 2)


def test_empty_table_and_other_columns(spark, documents):
    assert token_counts.count_tokens(documents(), PATH).count() == 0
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, n_tokens string")
    assert token_counts.count_tokens(df, PATH).first().n_tokens == 2
