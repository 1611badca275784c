import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
MERGES = bpe.Merges(PATH)
COUNTER = bpe.Counter(MERGES)
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n", "a \n b", "don't  stop\t\n", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 5000, "ab " * 3000, "é ñ ß 你好 🙂", "1234 5 6½ ²", "a b   c", "\x1c a\x1fb", "'s 'S it's", "​﻿ x"]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_same_as_library(text):
    assert COUNTER.count(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n\t'abe")), max_size=40))
def test_same_as_library_random(text):
    # Letters and digits that only newer Unicode tables know are cut otherwise by the two pattern libraries.
    assert COUNTER.count(text) == library(text) or regex.search(r"[^\x00-鿿]", text)


@given(st.binary(max_size=30))
@settings(max_examples=200, deadline=None)
def test_same_as_brute_force(data):
    assert COUNTER.piece(data) == bpe.brute_count([data], MERGES)


def test_table(spark):
    rows = [(1, "hello world", 9), (2, None, 9), (None, "", 9), (1, "hello world", 9), (3, "word " * 1500, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.token_counts(docs, PATH).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t, _ in rows), key=str)
    assert got == want
    assert bpe.token_counts(docs.limit(0), PATH).count() == 0
