"""Operator 3: merges by tier, versions, conflicts, removal."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, shard_store
from tidemark.llm.manifest import CommitConflict, Manifest


def shard(size, order=0):
    return {"path": f"p{size}-{order}", "bytes": size, "order": order}


def test_plan_merges_similar_sizes_up_to_the_target():
    kb = 1 << 10
    assert shard_store.plan_merges([shard(64 * kb, i) for i in range(3)], target=1 << 20) == []
    assert [len(g) for g in shard_store.plan_merges([shard(64 * kb, i) for i in range(4)], target=1 << 20)] == [4]
    groups = shard_store.plan_merges([shard(64 * kb, i) for i in range(64)] + [shard(5 << 20, 99)], target=1 << 20)
    assert sum(map(len, groups)) == 64 and all(sum(s["bytes"] for s in g) <= 1 << 20 for g in groups)
    assert len(groups) == 4


def test_store(spark):
    schema = spark.createDataFrame([], "doc_id long, text string, n_words int").schema
    store = shard_store.ShardStore(spark, common.scratch_path(spark, "s"), schema)
    assert store.read().count() == 0 and store.compact() == 0
    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"t{i}", i) for i in range(60)], schema).repartition(4)
    v = store.append(rows, arrival=rows["n_words"] % 6)
    assert v == 6 and store.read().count() == 60 and store.read(3).count() == 30
    before = len(store.manifest.read()[1])
    assert store.compact() == 7
    after = store.manifest.read()[1]
    assert len(after) < before and store.read().count() == 60 and store.read(6).count() == 60
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.collect()))
    gone = store.vacuum()
    assert before >= gone > 0 and store.vacuum() == 0
    assert store.read().count() == 60
    store.append(rows.limit(0))
    assert store.read().count() == 60


def test_commits_conflict(spark):
    path = common.scratch_path(spark, "m")
    one, two = Manifest(spark, path), Manifest(spark, path)
    assert one.commit(0, [{"path": "a"}]) == 1
    with pytest.raises(CommitConflict):
        two.commit(0, [{"path": "b"}])
    assert two.read() == (1, [{"path": "a"}]) and two.versions() == [1]


def test_versions_are_changes_with_a_base_now_and_then(spark):
    m = Manifest(spark, common.scratch_path(spark, "m"))
    for v in range(40):
        m.change(v, [{"path": f"p{v}"}], [f"p{v - 3}"] if v >= 3 else [])
    assert [e["path"] for e in m.read()[1]] == ["p37", "p38", "p39"] and [e["path"] for e in m.read(17)[1]] == ["p14", "p15", "p16"]
    assert m._names("b") == [16, 32] and m.read(1)[1] == [{"path": "p0"}]
    assert len(m._load("v000000000040.json")["added"]) == 1


def test_writers_at_once(spark):
    """An append that another writer outran is committed after it; a merge is given up if its shards are gone."""
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    path = common.scratch_path(spark, "s")
    one, two = (shard_store.ShardStore(spark, path, schema, fanout=2) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], schema).coalesce(1)
    one.append(rows(1)), one.append(rows(2))
    commit = one.manifest.change

    def outrun(after, added, removed=()):
        one.manifest.change = commit
        two.append(rows(3))
        return commit(after, added, removed)

    one.manifest.change = outrun
    assert one.append(rows(4)) == 4 and sorted(r["doc_id"] for r in one.read().collect()) == [1, 2, 3, 4]

    def merged_before(after, added, removed=()):
        one.manifest.change = commit
        two.compact()
        return commit(after, added, removed)

    one.manifest.change = merged_before
    one.compact()
    assert sorted(r["doc_id"] for r in one.read().collect()) == [1, 2, 3, 4]
    # what a failed writer left goes when it is old, and not before
    rows(9).write.parquet(f"{path}/shards/left")
    one.vacuum()
    assert spark.read.parquet(f"{path}/shards/left").count() == 1
    assert one.vacuum(orphans_after=0.0) == 1 and sorted(r["doc_id"] for r in two.read().collect()) == [1, 2, 3, 4]


def test_null_arrivals_and_names_that_clash(spark):
    names = "doc_id long, __arrival string, __path string, __group int, `a b` string"
    rows = spark.createDataFrame([(i, "x", "y", i, "z") for i in range(20)], names)
    store = shard_store.ShardStore(spark, common.scratch_path(spark, "s"), rows.schema, fanout=2)
    assert store.append(rows, arrival=F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 4)) == 3
    assert all(r["doc_id"] % 2 for r in store.read(1).collect()) and store.read().count() == 20
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))


def test_no_task_merges_more_than_the_target(spark):
    """The bound holds at any size: a target sixteen times smaller stands for sixteen times the rows."""
    rows = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = shard_store.ShardStore(spark, common.scratch_path(spark, "s"), rows.schema, target=200_000, fanout=4)
    store.append(rows.repartition(64), arrival=F.col("id") % 2)
    before = store.manifest.read()[1]
    groups = shard_store.plan_merges(before, store.target, store.fanout)
    assert len(groups) > 8 and max(sum(s["bytes"] for s in g) for g in groups) <= store.target
    store.compact()
    after = [s["bytes"] for s in store.manifest.read()[1]]
    assert max(after) <= 1.1 * store.target and len(after) < len(before) / 4 and store.read().count() == 40_000
