"""Operator 12 against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives

SCHEMA = "id long, label int, vector array<float>, rows string"


def plain(rows, anchor, positives=5, negatives=10, least=30, most=90):
    """By every pair; rows are (id, label, vector)."""
    width = max([len(v) for _, _, v in rows if v is not None], default=0)
    sound = [(i, b, [math.floor(256 * x) for x in v] + [0] * (width - len(v))) for i, b, v in rows if b is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for n, (i, b, v) in enumerate(sound):
        if not anchor(i):
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=True)), j, c) for m, (j, c, w) in enumerate(sound) if m != n), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for s, j, _ in [x for x in scored if x[2] == b][:positives]:
            inside = [x for x in scored if x[2] != b and least * s <= 100 * x[0] <= most * s][:negatives]
            found += [(i, j, r + 1, k, s, t) for r, (t, k, _) in enumerate(inside)]
    return found


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, monkeypatch, seed):
    """Small lists, groups and blocks; a hot vector, ties, nulls, odd lengths, repeated rows and ids."""
    rng = random.Random(seed)
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", (4, 16, 512)[seed])
    monkeypatch.setattr(hard_negatives, "GROUP_VALUES", ((40, 200), (300, 400), (1 << 18, 1 << 22))[seed])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", (3, 10, 4096)[seed])
    vec = lambda: [rng.choice([-1, 0, 0.5, 1, 2]) + (0.3 * rng.random() if seed else 0) for _ in range(6)]
    centres = [vec() for _ in range(5)]
    rows = [(i, rng.randrange(3), [c + rng.choice([0, 0, 0.1]) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(i, 1, centres[0]) for i in range(150, 230)]  # hot
    rows += [(7, 2, vec()), (7, 2, rows[7][2]), rows[20], rows[20], (None, 0, vec()), (None, 1, vec())]
    rows += [(300, None, vec()), (310, 1, None), (320, 1, [1.0, None]), (330, 2, [float("nan")] * 6), (340, 2, [float("inf")]), (350, 2, []), (360, 0, [1.0, 2.0])]
    rows = [(i, b, v and [None if x is None else float.fromhex(float(x).hex()) for x in v]) for i, b, v in rows]
    import numpy as np

    rows = [(i, b, v and [None if x is None else float(np.float32(x)) for x in v]) for i, b, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0, "id", "label", "vector").collect()]
    wanted = plain(rows, lambda i: i is not None and i % 10 == 0)
    assert wanted and sorted(found, key=key) == sorted(wanted, key=key)


def test_wide_values_and_empty(spark):
    rows = [(i, i % 2, [float(i * 1000), 3.0]) for i in range(20)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    found = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 5 == 0, "id", "label", "vector").collect()]
    assert sorted(found) == sorted(plain(rows, lambda i: i % 5 == 0))
    for none in (df.limit(0), df.where("id = 3")):
        assert hard_negatives.mine(none, F.col("id") % 5 == 0, "id", "label", "vector").collect() == []


def test_lists_are_skipped():
    """Bounds hold for every row, and far clusters are not visited."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    tables = []
    for n, centre in enumerate(np.eye(8) * 500):
        vectors = np.floor(centre + rng.normal(0, 5, (50, 8)))
        cols = {"vector": [v.astype("<i2").tobytes() for v in vectors], "id": list(range(n * 50, n * 50 + 50)), "row": list(range(n * 50, n * 50 + 50)), "label": [i % 2 for i in range(50)], "list": [n] * 50, "group": [0] * 50}
        tables.append(hard_negatives._pack(pa.table(cols), 8, "<i2"))
    lists = hard_negatives.Lists(pa.concat_tables(tables), 8, "<i2")
    anchors = np.floor(np.eye(8) * 480 + rng.normal(0, 5, (8, 8)))
    low, high = lists.bounds(anchors)
    for at, matrix in enumerate(lists.matrix):
        scores = anchors @ matrix.T
        assert (scores >= low[:, at, None]).all() and (scores <= high[:, at, None]).all()

    class Counted(list):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return super().__getitem__(at)

    lists.matrix = Counted(lists.matrix)
    list(hard_negatives.find_positives(anchors, [0] * 8, [-1] * 8, lists, 5))
    assert Counted.reads == 8  # one list an anchor, of eight
