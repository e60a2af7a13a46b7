"""All registered queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A Spark query over a directory of tables and, where SQL can express it, the same in DuckDB SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a query under ``name``."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, oracle)
        return run

    return add
