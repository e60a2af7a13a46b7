"""Operator 13 against counting by pairs."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, dominance, queries


def plain(rows):
    found = []
    for s, lv, _ in rows:
        if s is None or lv is None:
            found.append((None, None))
            continue
        over = [w for t, m, w in rows if t is not None and m is not None and t <= s and m > lv]
        found.append((len(over), sum(w or 0 for w in over)))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_any_split(spark, monkeypatch, seed):
    """Small parts, one hot level and one hot cell, ties, nulls, repeated and extreme values."""
    rng = random.Random(seed)
    monkeypatch.setattr(dominance, "CELLS", (1, 7, 30, 10**6)[seed])
    monkeypatch.setattr(dominance, "CELLS_A_SLOT", 0 if seed < 3 else 4)
    slots = [-(2**62), -5, *range(20), 2**62]
    rows = [(rng.choice(slots), rng.choice([7, 7, rng.randrange(-9, 9), -(2**63), 2**63 - 1]), rng.choice([1, 2, None])) for _ in range(300)]
    rows += [(3, 7, 2)] * 150 + [(None, 3, 1)] * 100 + [(4, None, 1)] * 5
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "__slot long, slot long, level long, weight int").repartition(3)
    found = dominance.above(df).collect()
    assert found[0].asDict().keys() == {"__slot", "slot", "level", "weight", "n_above", "weight_above"}
    assert [tuple(r)[4:] for r in sorted(found)] == plain(rows)


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "slot long, level long, weight long")
    assert dominance.above(empty).collect() == []
    nulls = spark.createDataFrame([(None, 1, 1), (2, None, 1)], empty.schema)
    assert [tuple(r)[3:] for r in dominance.above(nulls).collect()] == [(None, None)] * 2


def test_parts_are_even_and_a_hot_level_is_cut(spark, monkeypatch):
    monkeypatch.setattr(dominance, "CELLS", 500)
    df = spark.range(20000).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("slot"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90))).alias("level"), F.lit(1).alias("weight"))
    df = common.written(df, "rows")
    sizes = []
    real = dominance.sweep
    monkeypatch.setattr(dominance, "sweep", lambda *a: sizes.append(len(a[0])) or real(*a))  # only in this process
    cells = df.groupBy("slot", "level").agg(F.count("*").alias("n"))
    pairs = cells.alias("a").join(cells.alias("b"), F.expr("b.slot <= a.slot and b.level > a.level"), "left").groupBy("a.slot", "a.level").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("e"))
    assert dominance.above(df).join(pairs, ["slot", "level"]).where("n_above <> e or n_above is null").count() == 0


def test_query_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
        rows = queries.op13_dominance(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    known = [r for r in rows if r["slot"] is not None and r["level"] is not None]
    assert 0 < len(known) < len(rows)
    for r in known[::97]:
        over = [x for x in known if x["slot"] <= r["slot"] and x["level"] > r["level"]]
        assert r["n_sales"] == len(over) and r["n_rows"] == sum(1 + zlib.crc32(str(x["sale_id"]).encode()) % 2 for x in over)
