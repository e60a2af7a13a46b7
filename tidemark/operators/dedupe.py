"""Keeping one of several: the latest version, the first per anchor, what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that comes first by ``order`` for each key. The order should end in a tie-break, for results that repeat."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def latest_by_aggregate(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The same by one aggregation, which combines before the shuffle: better where keys have many versions."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("__row")).select(*keys, "__row.*")


def anchor_greedy(rows: DataFrame, keys: list[str], date: str, days: int) -> DataFrame:
    """keys, date of the events kept: scanning each key's dates in order, one is kept if it is more than ``days`` days after
    the last one kept. A gap to the previous row would not do: the distance counts from the kept anchor.

    The fold holds one key's distinct dates, of which a century has 36,525.
    """
    days_of = rows.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(date)).alias("__dates"))
    start = F.array().cast(f"array<{dict(rows.dtypes)[date]}>")
    keep = lambda kept, d: F.when((F.size(kept) == 0) | (F.datediff(d, F.element_at(kept, -1)) > days), F.array_append(kept, d)).otherwise(kept)
    return days_of.select(*keys, F.explode(F.aggregate("__dates", start, keep)).alias(date))


def pending(wanted: DataFrame, done: DataFrame, key: str | list[str], limit: int | None = None) -> DataFrame:
    """What is wanted and not done, in key order up to ``limit``."""
    left = wanted.join(done, key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")
