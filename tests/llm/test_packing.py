"""Operator 9: constraints, cuts, gapless bins, and how few sequences it needs."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path as vocabulary_path
from tokenizers import Tokenizer

from tidemark.llm import packing

VOCABULARY = vocabulary_path("byte_bpe_50k.json")


def norm_of(bins, b):
    t, d, a = bins.residual[b]
    ct, cd, ca = bins.capacity
    wt, wd, wa = bins.weights
    return wt * (t / ct) ** 2 + wd * (d / cd) ** 2 + wa * (a / ca) ** 2


def test_best_fit_is_the_feasible_bin_of_least_norm():
    rng = random.Random(1)
    bins = packing.VectorBins(64, 4, 1500, weights=(1.0, 0.5, 0.5))
    for _ in range(400):
        length = rng.randint(1, 38)
        open_bins = [b for b, (t, d, a) in enumerate(bins.residual) if t >= length and d >= 1 and a >= length * length]
        norms = {b: norm_of(bins, b) for b in open_bins}
        n = len(bins.residual)
        b, _ = bins.place(length)
        assert (b == n) == (not open_bins)
        if open_bins:
            assert norms[b] == pytest.approx(min(norms.values()))
    assert all(min(r) >= 0 for r in bins.residual)
    with pytest.raises(ValueError):
        bins.place(65)


def test_cut():
    assert list(packing.cut(5, 2048)) == [(0, 5)]
    assert list(packing.cut(4096, 2048)) == [(0, 2048), (2048, 2048)]
    assert list(packing.cut(4097, 2048)) == [(0, 1), (1, 2048), (2049, 2048)]


def test_few_sequences():
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    rows = [(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)]
    made = list(packing.place_group(rows, 3, (2048, 2048, 2048**2)))
    assert len({r[5] for r in made}) <= math.ceil(sum(lengths) / 2048) * 1.01 + 1


def test_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "same", "same", "long " * 6000]
    docs = spark.createDataFrame([(i if i < 62 else 62, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    wanted = sorted((min(i, 62), start, n, zlib.crc32(x[start : start + n].tobytes())) for i, x in enumerate(ids) for start, n in packing.cut(len(x), 512))
    for limits in ({}, {"most_documents": 3}, {"most_attention": 512 * 512, "most_documents": 5}):
        found = packing.pack(docs, VOCABULARY, end_id=0, most_tokens=512, **limits).collect()
        assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
        bins = defaultdict(list)
        for r in found:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
            assert sum(n for _, n in own) <= 512 and len(own) <= limits.get("most_documents", 512) and sum(n * n for _, n in own) <= limits.get("most_attention", 512**2)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_equal_rows_are_dealt_to_groups(spark, monkeypatch):
    """No group is larger than twice what groups are made for, though all rows are alike."""
    monkeypatch.setattr(packing, "GROUP_DOCS", 500)
    docs = spark.range(0, 8000, 1, 4).selectExpr("cast(null as long) as doc_id", "if(id % 3 = 0, '', 'one two') as text")
    found = packing.pack(docs, vocabulary_path("byte_bpe_50k.json")).selectExpr("sequence_id >> 40 as g").groupBy("g").count().collect()
    assert len(found) == 16 and max(r["count"] for r in found) <= 1000 and sum(r["count"] for r in found) == 8000
