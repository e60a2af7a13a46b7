"""A versioned list of immutable files, committed by an atomic rename that never overwrites.

A version is a file of what it adds and removes; every ``BASE_EVERY`` versions a base lists all entries, so a commit writes
what it changes and reading takes one base and a bounded number of changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import common

BASE_EVERY = 16


class CommitConflict(RuntimeError):
    """Another writer has committed this version first; read the latest and try again."""


class Manifest:
    """Versions ``v000000000001.json`` and on in a folder of any Hadoop file system. Entries have a ``path`` that is theirs alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _names(self, kind: str) -> list[int]:
        where, system = common.file_system(self.spark, self.path)
        if not system.exists(where):
            return []
        names = (status.getPath().getName() for status in system.listStatus(where))
        return sorted(int(n[1:-5]) for n in names if n.startswith(kind) and n.endswith(".json"))

    def versions(self) -> list[int]:
        return self._names("v")

    def _load(self, name: str) -> dict:
        where, system = common.file_system(self.spark, f"{self.path}/{name}")
        stream = system.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, entries); the latest by default, (0, []) before the first commit."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return 0, []
        base = max((b for b in self._names("b") if b <= version), default=0)
        entries = {e["path"]: e for e in self._load(f"b{base:012d}.json")["entries"]} if base else {}
        for v in range(base + 1, version + 1):
            change = self._load(f"v{v:012d}.json")
            for path in change["removed"]:
                entries.pop(path, None)
            entries |= {e["path"]: e for e in change["added"]}
        return version, list(entries.values())

    def _put(self, name: str, content: dict) -> bool:
        """Write a file that appears whole or not at all; whether it was not there before."""
        jvm = self.spark.sparkContext._jvm
        made, system = common.file_system(self.spark, f"{self.path}/.{uuid.uuid4().hex}.tmp")
        stream = system.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(made, target, no_options)
        except Exception as error:
            system.delete(made, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def change(self, after: int, added: list[dict], removed: list[str] = ()) -> int:
        """Make version ``after`` + 1 of version ``after``, or raise CommitConflict if there is one."""
        version = after + 1
        if not self._put(f"v{version:012d}.json", {"version": version, "added": added, "removed": list(removed)}):
            raise CommitConflict(f"version {version} is taken")
        if version % BASE_EVERY == 0:
            self._put(f"b{version:012d}.json", {"version": version, "entries": self.read(version)[1]})
        return version

    def commit(self, after: int, entries: list[dict]) -> int:
        """Make ``entries`` version ``after`` + 1, or raise CommitConflict if there is one."""
        before = {e["path"]: e for e in self.read(after)[1]}
        wanted = {e["path"]: e for e in entries}
        return self.change(after, [e for p, e in wanted.items() if before.get(p) != e], [p for p in before if p not in wanted])

    def update(self, plan: Callable[[int, list[dict]], tuple[list[dict], list[str]] | None], tries: int = 20) -> int:
        """Commit what ``plan`` (version, entries) says to add and remove, planned anew whenever another writer was first;
        nothing if it gives None. The version after it."""
        for _ in range(tries):
            version, entries = self.read()
            wanted = plan(version, entries)
            if wanted is None:
                return version
            try:
                return self.change(version, *wanted)
            except CommitConflict:
                continue
        raise CommitConflict(f"{tries} other writers were first")
