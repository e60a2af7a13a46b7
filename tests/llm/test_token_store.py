"""Operator 1 against the library on small rows: exact round trip, offsets, hashes, odd inputs."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path as vocabulary_path
from tokenizers import Tokenizer

from tidemark.llm import common, token_store, tokens

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
ODD = ["", " ", "a", "\n", "\n\n", " a  b", "a \n b", "a\tb c", "x  y", "a\n\nb", "it's  'll", " é ñ", "a\x1cb \x1c c", "<|endoftext|> x", "see <|endoftext|> here", "a b<|endoftext|>", "a <|endof text|> b", "tail \n", "word " * 3000, "z" * 5000, "1 2\n3"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(library):
    encoder, width = tokens.library_encoder(VOCABULARY)
    small = tokens.PieceEncoder(encoder.encode_many, encoder.encode_pieces, most=3)  # is trimmed at each call
    for one in (encoder, small):
        for _ in range(2):
            assert [np.frombuffer(x, f"<u{width}").tolist() for x in one.encode(ODD)] == [library(x) for x in ODD]
        assert [np.frombuffer(x, f"<u{width}").tolist() for x in one.encode(["a b\nc"])] == [library("a b\nc")]


def test_store_round_trip(spark, library):
    rows = [(7 * i % 101, t, "clash", i) for i, t in enumerate(ODD)] + [(3, None, "x", 0), (3, None, "x", 0), (200, "same", "x", 1), (200, "same", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int").repartition(3)
    path = common.scratch_path(spark, "t")
    token_store.write(docs, path, VOCABULARY, end_id=2)
    found = sorted(token_store.digests(spark, path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    assert [r["doc_id"] for r in found] == sorted(r[0] for r in rows)
    at = 0
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(library(t or "") + [2])
    for row in found:
        assert row["start"] == at
        at += row["n_tokens"]
        assert row["ids_crc32"] in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in texts[row["doc_id"]]}
    for i in texts:
        assert sorted(token_store.fetch(spark, path, i)) == sorted(texts[i])
    assert len(token_store.dictionaries(spark, path)) == 1


def test_empty_table(spark):
    path = common.scratch_path(spark, "t")
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY, end_id=2)
    assert token_store.digests(spark, path).collect() == []


def test_hot_and_null_ids_are_split_and_fetch_prunes(spark):
    rows = [(7, f"hot {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i + 100, f"text {i}") for i in range(300)]
    path = common.scratch_path(spark, "t")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCABULARY, end_id=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert max(len(b["doc_ids"]) for b in blocks) < 200 and sum(len(b["doc_ids"]) for b in blocks) == 900
    found = sorted(token_store.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:i]) for i in range(900)]
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert len(token_store.fetch(spark, path, 7)) == 300 and len(token_store.fetch(spark, path, 150)) == 1 and token_store.fetch(spark, path, 99) == []


def test_equal_rows_are_dealt_apart(spark):
    """Rows that repeat whole go to all shards, and ids are still those of all rows in order."""
    docs = spark.range(0, 40_000, 1, 4).selectExpr("if(id % 2 = 0, 7, null) as doc_id", "'same text' as text")
    path = common.scratch_path(spark, "same")
    with common.settings(spark, {"spark.sql.shuffle.partitions": "16"}):
        token_store.write(docs, path, VOCABULARY, end_id=2)
        found = token_store.digests(spark, path)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/blocks").selectExpr("shard", "size(doc_ids) as n").groupBy("shard").sum("n").selectExpr("`sum(n)` as count").collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * 40_000 / 16
    rows = found.orderBy("start").collect()
    n = rows[0]["n_tokens"]
    assert [r["start"] for r in rows] == [i * n for i in range(40_000)] and len({r["ids_crc32"] for r in rows}) == 1
