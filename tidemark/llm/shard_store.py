"""Operator 3: shards of a growing table with size-tiered compaction and a versioned manifest. Native: DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Shards are tiered by size, each tier ``fanout`` times the last;
when a tier has ``fanout`` shards, runs of them are merged, and so on until no tier has as many or shards reach the
target size. Merges are planned on sizes alone and then done by one job, in which no task writes more than the target.
A version of the manifest names the live shards; it is committed by an atomic rename, so readers see all of a change or
nothing, and a failed or lost job leaves the last version as it was. A writer that finds its version taken plans its
change anew on the version that took it. Shards that no version since ``keep`` ago names can be removed, and those that no
version ever named (of writers that failed) once they are old.

Nulls, repeated rows and other columns are stored as they are, whatever their names; rows whose arrival is null are an
arrival of their own, before all others; an empty arrival commits a version without new shards; reading an empty store
gives an empty table of the given schema.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .manifest import Manifest

TARGET_BYTES, FANOUT, SMALLEST_BYTES = 128 << 20, 4, 64 << 10
#: Files that one job merges at most; it broadcasts a row of about 200 bytes for each.
MOST_FILES = 50_000


def tier(size: int, fanout: int = FANOUT, smallest: int = SMALLEST_BYTES) -> int:
    return 0 if size <= smallest else 1 + int(math.log(size / smallest, fanout))


def plan_merges(shards: list[dict], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[dict]]:
    """Groups of shards to merge, each into one shard of at most ``target`` bytes. Sizes of merged shards are taken to add up."""
    live = [{"bytes": s["bytes"], "order": s["order"], "parts": [s]} for s in shards]
    while True:
        tiers: dict[int, list[dict]] = {}
        for run in live:
            if run["bytes"] < target:
                tiers.setdefault(tier(run["bytes"], fanout), []).append(run)
        merged = None
        for level in sorted(tiers):
            if len(tiers[level]) < fanout:
                continue
            groups, size = [[]], 0
            for run in sorted(tiers[level], key=lambda r: r["order"]):
                if groups[-1] and size + run["bytes"] > target:
                    groups.append([])
                    size = 0
                groups[-1].append(run)
                size += run["bytes"]
            groups = [g for g in groups if len(g) > 1]
            if groups:
                merged = groups
                break
        if merged is None:
            return [run["parts"] for run in live if len(run["parts"]) > 1]
        gone = {id(run) for group in merged for run in group}
        live = [run for run in live if id(run) not in gone]
        live += [{"bytes": sum(r["bytes"] for r in g), "order": g[0]["order"], "parts": [s for r in g for s in r["parts"]]} for g in merged]


class ShardStore:
    """A table of ``schema`` in shards below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.schema, self.target, self.fanout = spark, path, schema, target, fanout
        self.manifest = Manifest(spark, f"{path}/manifest")

    def _files(self, folder: str) -> DataFrame:
        """path, bytes, modified of the shards below a folder, listed by Spark without reading them."""
        where, system = common.file_system(self.spark, folder)
        if not system.exists(where):
            return self.spark.createDataFrame([], "path string, bytes long, modified timestamp")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(folder)
        return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def _made(self, folder: str) -> list[dict]:
        """What a job has just committed: one row of the manifest a shard."""
        return sorted(({"path": r["path"], "bytes": r["bytes"]} for r in self._files(folder).select("path", "bytes").collect()), key=lambda s: s["path"])

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Append ``rows`` without a shuffle, each task writing small shards. With ``arrival`` (a long), rows of each value are
        an arrival of their own: one job writes them all, and each is then committed as its own version, in order."""
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        (own,) = common.fresh(self.schema.names, "arrival")
        rows = rows.withColumn(own, (F.lit(0) if arrival is None else arrival).cast("long")).select(*common.columns(self.schema.names), own)
        rows.write.option("compression", "zstd").partitionBy(own).parquet(folder)
        arrivals: dict[str, list[dict]] = {}
        for shard in self._made(folder):
            arrivals.setdefault(shard["path"].rpartition("/")[0], []).append(shard)
        version = 0
        for name in sorted(arrivals, key=_arrival) or [None]:
            version = self.manifest.update(lambda version, _, name=name: ([s | {"order": version + 1} for s in arrivals.get(name, [])], []))
        return version

    def compact(self) -> int:
        """Merge by size tiers and commit the outcome; the version after it. Another writer's appends meanwhile are kept; if
        one has merged a shard that this merge took, this merge is given up."""
        version, entries = self.manifest.read()
        groups = plan_merges(entries, self.target, self.fanout)
        if not groups:
            return version
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        gone: set[str] = set()
        wave: list[list[dict]] = []
        for group in [*groups, None]:  # a wave per job, of as many files as may be broadcast
            if wave and (group is None or sum(map(len, wave)) + len(group) > MOST_FILES):
                gone |= self._merge(wave, folder)
                wave = []
            wave += [group] if group else []
        made = self._made(folder)

        def swap(version: int, now: list[dict]):
            if not gone <= {s["path"] for s in now}:
                return None
            return [s | {"order": version + 1} for s in made], sorted(gone)

        before = version
        version = self.manifest.update(swap)
        if version > before and not {s["path"] for s in made} <= {s["path"] for s in self.manifest.read(version)[1]}:
            common.delete(self.spark, folder)
        return version

    def _merge(self, groups: list[list[dict]], folder: str) -> set[str]:
        """Write each group as one shard below ``folder``: rows move once, straight to their group's task. The paths merged."""
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        path, place = common.fresh(self.schema.names, "path", "group")
        goes = [(s["path"], g) for g, group in enumerate(groups) for s in group]
        table = self.spark.createDataFrame(goes, f"{path} string, {place} int").withColumn(path, plain(path))
        merged = self.spark.read.schema(self.schema).parquet(*[p for p, _ in goes]).withColumn(path, plain("_metadata.file_path"))
        merged = merged.join(F.broadcast(table), path)  # MOST_FILES rows at most
        merged = merged.repartitionById(len(groups), F.col(place)).select(*common.columns(self.schema.names))
        merged.write.mode("append").option("compression", "zstd").parquet(folder)
        return {p for p, _ in goes}

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the latest by default."""
        _, entries = self.manifest.read(version)
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s["path"] for s in entries])

    def vacuum(self, keep: int = 1, orphans_after: float | None = 86_400.0) -> int:
        """Remove the shards that none of the last ``keep`` versions names, and those that no version names and that are older
        than ``orphans_after`` seconds (None: none of these), as a writer at work may still name younger ones. How many."""
        known = self.manifest.versions()
        live = {s["path"] for v in known[-keep:] for s in self.manifest.read(v)[1]}
        named, gone = set(), 0
        for version in known:
            change = self.manifest._load(f"v{version:012d}.json")
            named |= {s["path"] for s in change["added"]}
        there = self._files(f"{self.path}/shards")
        if orphans_after is None:
            there = there.where(F.lit(False))
        old = there.where(F.col("modified") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(orphans_after or 0.0))))
        lost = {r["path"] for r in old.select("path").toLocalIterator()} - named
        for path in (named | lost) - live:
            where, system = common.file_system(self.spark, path)
            gone += bool(system.exists(where) and system.delete(where, False))
        return gone


def _arrival(folder: str) -> float:
    """The arrival that a partition's folder names; a null one is least."""
    value = folder.rpartition("=")[2]
    return -math.inf if value == "__HIVE_DEFAULT_PARTITION__" else int(value)
