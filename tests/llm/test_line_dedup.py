"""Operator 6 against a plain Python reading of its contract."""

import random
from collections import defaultdict

from tidemark.llm import common, line_dedup

LOW = str.maketrans(common.UPPER, common.LOWER)
SPACES = " \t\n\x0b\x0c\r"


def plain(texts, least):
    key = lambda x: x.strip(SPACES).translate(LOW)
    docs = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    gone = {k for k, d in docs.items() if k and len(d) >= least}
    return ["\n".join(x for x in (t or "").split("\n") if key(x) not in gone) for t in texts]


def test_against_plain(spark):
    rng = random.Random(5)
    pool = ["Aé", "aÉ", "aé", " x ", "X", " x", "line one", "LINE ONE\t", "", " ", "q"] + [f"u{i}" for i in range(200)]
    texts = [None, "", "\n", "x\nx\nx"] + ["\n".join(rng.choices(pool, k=rng.randint(0, 8))) for _ in range(150)] + ["Same copy\nsecond"] * 10 + ["nine"] * 9
    ids = [i // 2 if i < 20 else i for i in range(len(texts))]  # some rows share an id
    ids[30] = None
    rows = [(i, t, n, 7) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, hash int")
    found = {r["n"]: r for r in line_dedup.dedupe(docs, min_docs=10).collect()}
    for n, kept in enumerate(plain(texts, 10)):
        assert found[n]["text"] == kept, n
        before = (texts[n] or "").count("\n") + 1
        assert found[n]["n_lines"] == before
    assert len(found) == len(texts)
    assert line_dedup.dedupe(docs.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, common.scratch_path(spark, "r"), min_docs=7, fanout=2)
    docs = spark.createDataFrame([(i, f"a\nb{i % 3}") for i in range(6)], "doc_id long, text string")
    hashed = line_dedup.hashed_batches(docs, 1)
    levels = []
    for _ in range(4):
        runs.add(hashed)
        levels.append(sorted(e["level"] for e in runs.manifest.read()[1]))
    assert levels == [[0], [1], [0, 1], [2]]
    # "a" is frequent with the second batch and counted no more; the others, twice a batch, with the fourth
    assert sorted((r["docs"], r["frequent"]) for r in runs.rows().collect()) == [(8, True)] * 3 + [(12, True)]
    assert runs.frequent().count() == 4
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_run")]


def test_a_batch_meets_the_runs_without_moving_them(spark):
    runs = line_dedup.LineRuns(spark, common.scratch_path(spark, "r"), min_docs=2, fanout=9)
    docs = spark.createDataFrame([(i, f"a\nb{i % 3}\nc{i}") for i in range(60)], "doc_id long, text string")
    hashed = line_dedup.hashed_batches(docs, 3)
    for i in range(2):
        runs.add(hashed.where(f"batch = {i}"))
    with common.settings(spark, line_dedup.SORTED_BUCKETS):
        plan = runs.fresh(hashed.where("batch = 2"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and plan.count("LeftAnti") == 2
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan  # of the batch alone
    assert plan.index("partial_count") > plan.index("Exchange") > plan.rindex("LeftAnti"), plan  # and of its counts
    runs.close()


def test_merges_of_more_runs(spark):
    runs = line_dedup.LineRuns(spark, common.scratch_path(spark, "r"), min_docs=5, fanout=3)
    docs = spark.createDataFrame([(i, f"a\nb{i % 7}") for i in range(40)], "doc_id long, text string")
    hashed = line_dedup.hashed_batches(docs, 3)
    for i in range(3):
        runs.add(hashed.where(f"batch = {i}"))
    assert [e["level"] for e in runs.manifest.read()[1]] == [1]
    assert runs.rows().count() == 8 and runs.frequent().count() == 8
    runs.close()


def test_batches_as_they_arrive(spark):
    runs = line_dedup.LineRuns(spark, common.scratch_path(spark, "r"), min_docs=3)
    batch = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = runs.ingest(batch("a\nb", "a\nc")).collect()
    second = runs.ingest(batch("A \nd", "d")).collect()
    assert sorted(r["text"] for r in first) == ["a\nb", "a\nc"] and sorted(r["text"] for r in second) == ["d", "d"]


def test_names_that_clash(spark):
    names = ["__id", "__hits", "__kept", "hash", "docs", "batch", "hashes", "line", "x y"]
    docs = spark.createDataFrame([(i, "a\nb", *names) for i in range(10)], ["doc_id", "text", *names])
    found = line_dedup.dedupe(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {tuple(r) for r in found.drop("doc_id").collect()} == {("", *names, 2, 2)}
    more = docs.selectExpr("*", "'own' as n_lines", "7 as __n_dropped")
    assert {tuple(r) for r in line_dedup.clean(more).drop("doc_id").collect()} == {("", *names, "own", 7)} and line_dedup.clean(more).columns == more.columns
