"""Operator 6: lines that many documents share, found with levelled sorted runs of line hashes. Native: DataFrame functions only.

A run holds, bucketed and sorted by hash, each line hash that a batch has brought, the number of the batch's documents
with the line, and whether all batches so far make it frequent. A batch merge-anti-joins the runs: hashes that are
frequent already need no more counting. What is left is merge-joined with the counts of the runs, and added as a run of
its own. Runs have equal buckets, so only the batch is shuffled, never a run. Once a level has ``fanout`` runs, they are
merge-joined into one of the next level. The manifest lists the live runs and is committed atomically.

``dedupe``, the registered path, lets all documents arrive in batches and then drops the frequent lines from all, as
its counts are over all documents; ``ingest`` cleans each batch as it arrives, by what is frequent so far.

A line's key is the line without white space at its ends and with A-Z lower-cased. Every row is a document. A null or
empty text is one empty line; empty keys are never dropped; rows with equal or null doc_id are each cleaned on their
own text; an empty table gives an empty result; other columns pass through, whatever their names (``N_LINES`` and
``N_DROPPED`` of ``dedupe`` take the place of columns called so). Keys are told apart by MD5: of 10^12 different lines
two share all 128 bits with a chance of about 10^-15.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .manifest import Manifest

SPACES = " \t\n\x0b\x0c\r"
FANOUT = 2
N_LINES, N_DROPPED = "n_lines", "n_dropped"
RUN_SCHEMA = "hash string, docs long, frequent boolean"
#: Runs have one file a bucket, sorted: their order is relied on, and no join sorts them again. Anti-joins stay above the
#: batch's counts, else lines would be shuffled one by one.
SORTED_BUCKETS = {"spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.enabled": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def line_hashes(text: Column) -> Column:
    """Of each line, in order; null for lines without a key."""
    keys = F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(keys, lambda x: F.when(F.btrim(x, F.lit(SPACES)) != "", F.md5(F.btrim(x, F.lit(SPACES)))))


def own_hashes(hashes: str) -> Column:
    return F.explode(F.array_distinct(F.filter(hashes, lambda h: h.isNotNull())))


class LineRuns:
    """Levelled runs below ``path``, for lines of at least ``min_docs`` documents."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.manifest = Manifest(spark, f"{path}/manifest")
        self.buckets = common.shuffle_partitions(spark)

    def _table(self, run: dict) -> DataFrame:
        """The catalog's view of a run's files, which tells Spark how they are bucketed and sorted."""
        if not self.spark.catalog.tableExists(run["table"]):
            layout = f"clustered by (hash) sorted by (hash) into {run['buckets']} buckets"
            self.spark.sql(f"create table {run['table']} ({RUN_SCHEMA}) using parquet {layout} location '{run['path']}'")
        return self.spark.table(run["table"])

    def _write(self, rows: DataFrame) -> dict:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        run = {"table": name, "path": f"{self.path}/runs/{name}", "buckets": self.buckets}
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", run["path"]).saveAsTable(name)
        return run

    def _forget(self, run: dict) -> None:
        self.spark.sql(f"drop table if exists {run['table']}")
        common.delete(self.spark, run["path"])

    def fresh(self, hashed: DataFrame) -> DataFrame:
        """hash, docs, frequent of the lines of a batch (a column ``hashes`` as line_hashes gives it) that are not frequent yet."""
        new = hashed.select(own_hashes("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("docs"))
        runs = [self._table(r) for r in self.manifest.read()[1]]
        for run in runs:
            new = new.join(run.where("frequent").select("hash").hint("merge"), "hash", "left_anti")
        total = F.col("docs")
        for i, run in enumerate(runs):
            new = new.join(run.where("not frequent").select("hash", F.col("docs").alias(f"docs_{i}")).hint("merge"), "hash", "left")
            total = total + F.coalesce(f"docs_{i}", F.lit(0))
        return new.select("hash", "docs", (total >= self.min_docs).alias("frequent"))

    def add(self, hashed: DataFrame) -> None:
        """Add a batch as a run of level 0, then merge full levels."""
        with common.settings(self.spark, SORTED_BUCKETS):
            run = self._write(self.fresh(hashed))
        version, entries = self.manifest.read()
        self.manifest.commit(version, [*entries, run | {"level": 0}])
        self.compact()

    def compact(self) -> None:
        """Merge each level that has ``fanout`` runs into one of the next."""
        while True:
            version, entries = self.manifest.read()
            full = next((k for k in sorted({e["level"] for e in entries}) if sum(e["level"] == k for e in entries) >= self.fanout), None)
            if full is None:
                return
            merged = [e for e in entries if e["level"] == full]
            queue = merged
            while len(queue) > 1:
                made = self._merge(*queue[:2])
                for run in queue[:2]:
                    if run not in merged:
                        self._forget(run)
                queue = [*queue[2:], made]
            self.manifest.commit(version, [e for e in entries if e not in merged] + [queue[0] | {"level": full + 1}])
            for entry in merged:
                self._forget(entry)

    def _merge(self, one: dict, two: dict) -> dict:
        """Both runs as one, by a merge join that moves and sorts neither."""
        with common.settings(self.spark, SORTED_BUCKETS):
            other = self._table(two).select("hash", F.col("docs").alias("more"), F.col("frequent").alias("too"))
            both = self._table(one).hint("merge").join(other, "hash", "full_outer")
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return self._write(both.select("hash", docs.alias("docs"), (F.coalesce("frequent", F.lit(False)) | F.coalesce("too", F.lit(False))).alias("frequent")))

    def rows(self) -> DataFrame:
        """hash, docs, frequent of all runs; a hash may be in several, but is frequent in one at most."""
        found = [self.spark.read.schema(RUN_SCHEMA).parquet(e["path"]) for e in self.manifest.read()[1]]
        rows = self.spark.createDataFrame([], RUN_SCHEMA)
        for run in found:
            rows = rows.union(run)
        return rows

    def frequent(self) -> DataFrame:
        return self.rows().where("frequent").select("hash")

    def close(self) -> None:
        """Remove the runs."""
        for entry in self.manifest.read()[1]:
            self._forget(entry)

    def ingest(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Clean a batch as it arrives: its run is added, and the batch loses the lines that at least ``min_docs`` documents
        of all batches so far have. Documents of earlier batches are as they were."""
        hashed = hashed_batches(docs, 1, key, text)
        self.add(hashed)
        return drop_frequent(docs, hashed, common.written(self.frequent(), "frequent-lines"), key, text)


def hashed_batches(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hashes and a batch from 0 to ``n`` - 1, as they might have come in; the texts are read and hashed once, in one job."""
    hashed = docs.select(F.col(key).alias("doc_id"), line_hashes(F.col(text)).alias("hashes"), F.pmod(F.xxhash64(key), F.lit(n)).alias("batch"))
    return common.written(hashed, "line-hashes", "batch")


def drop_frequent(docs: DataFrame, hashed: DataFrame, frequent: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, str] = (N_LINES, N_DROPPED)) -> DataFrame:
    """``docs`` without the lines whose hash is in ``frequent``, and how many lines there were and went, called ``names``.

    hashed: doc_id, hashes of the same documents. Hashes meet the frequent ones by a merge join; each document then gets
    only its own frequent hashes, so no broadcast grows with the corpus, and texts move at most once.
    """
    n_lines, n_dropped = names
    docs = docs.select(*common.columns([c for c in docs.columns if c not in names]))
    own_id, hits, kept = common.fresh([*docs.columns, *names], "id", "hits", "kept")
    pairs = hashed.select("doc_id", own_hashes("hashes").alias("hash"))
    found = pairs.join(frequent, "hash", "left_semi").groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("hash").alias(hits))
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    with_hashes = F.arrays_zip(lines.alias("line"), line_hashes(whole).alias("hash"))
    left = F.transform(F.filter(with_hashes, lambda x: ~F.coalesce(F.array_contains(hits, x["hash"]), F.lit(False))), lambda x: x["line"])
    others = common.columns(docs.columns)
    found = docs.join(found, F.col(key).eqNullSafe(F.col(own_id)), "left")
    found = found.select(*others, F.size(lines).cast("long").alias(n_lines), F.when(F.col(hits).isNotNull(), left).alias(kept))
    dropped = F.when(F.col(kept).isNull(), 0).otherwise(F.col(n_lines) - F.size(kept)).cast("long")
    cleaned = F.when(F.col(kept).isNull(), whole).otherwise(F.array_join(kept, "\n")).alias(text)
    return found.select(*[cleaned if n == text else c for n, c in zip(docs.columns, others, strict=True)], n_lines, dropped.alias(n_dropped))


def clean(docs: DataFrame, min_docs: int = 10, **options) -> DataFrame:
    """``docs`` without the frequent lines, with their columns."""
    return dedupe(docs, min_docs, names=tuple(common.fresh(docs.columns, N_LINES, N_DROPPED)), **options).select(*common.columns(docs.columns))


def dedupe(docs: DataFrame, min_docs: int = 10, n_batches: int = 4, key: str = "doc_id", text: str = "text", names: tuple[str, str] = (N_LINES, N_DROPPED)) -> DataFrame:
    """Let all of ``docs`` arrive in batches, then drop lines of at least ``min_docs`` documents from every document."""
    spark = docs.sparkSession
    runs = LineRuns(spark, common.scratch_path(spark, "line-runs"), min_docs)
    hashed = hashed_batches(docs, n_batches, key, text)
    for i in range(n_batches):
        runs.add(hashed.where(F.col("batch") == i))
    frequent = common.written(runs.frequent(), "frequent-lines")
    runs.close()
    return drop_frequent(docs, hashed, frequent, key, text, names)
