"""Operator 4 against the tiktoken library, and decoding as the exact inverse."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import rank_bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "\n", "\n\n", " a  b", "a \n b", "a\tb c", "x  y", "it's  'll", " é ñ 漢字 🙂🙂", "a\x1cb \x1c c\x85d\xa0 e", "<|endoftext|> x", "tail \n", "word " * 500, "z" * 3000, "ab" * 2000, "1 2\n3", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    ranks = rank_bpe.rank_encoder(VOCABULARY, P.PATTERN)[0].ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_are_those_of_the_library(library):
    encoder, pieces = rank_bpe.rank_encoder(VOCABULARY, P.PATTERN)
    for text in ODD:
        assert encoder.encode(text) == library(text), text
        assert encoder.decode(library(text)) == text.encode()
    assert [np.frombuffer(x, encoder.kind).tolist() for x in pieces.encode(ODD)] == [library(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab thex'sll\n\t é 漢1.,-\x1c"), max_size=60))
def test_random_texts(text):
    encoder, pieces = rank_bpe.rank_encoder(VOCABULARY, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={}).encode_ordinary
    assert encoder.encode(text) == library(text)
    assert np.frombuffer(pieces.encode([text])[0], encoder.kind).tolist() == library(text)


def test_queue_is_empty_after_each_piece():
    encoder, _ = rank_bpe.rank_encoder(VOCABULARY, P.PATTERN)
    for text in ODD:
        encoder.encode(text)
        assert not any(encoder.words)


def test_rows(spark):
    rows = [(5, None, "n"), (5, None, "n"), (1, "", "n"), (2, "a long text " * 50, "n"), (None, "x", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = rank_bpe.decode_documents(rank_bpe.encode_documents(docs, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["content"])) for r in found) == sorted((i or 0, (t or "").encode()) for i, t, _ in rows)
    assert {r["ids_sha256"] for r in found if r["n_tokens"] == 0} == {hashlib.sha256(b"").hexdigest()}
    assert rank_bpe.encode_documents(docs.limit(0), VOCABULARY, P.PATTERN).collect() == []
