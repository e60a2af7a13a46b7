"""As-of joins: one union and one window over each key's dates, so their cost is a sort, not a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, forward: bool = False, name: str = "asof_date") -> DataFrame:
    """``left`` with the nearest date of ``right`` for the same keys: the latest on or before its own, or the first on or
    after it with ``forward``; null if there is none. Without keys all dates lie in one window: for calendars only."""
    marks = right.select(*keys, F.col(right_date).alias("__date"), F.col(right_date).alias("__mark")).distinct()
    both = left.withColumn("__date", F.col(left_date)).withColumn("__left", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    side = F.when(F.col("__left"), 1).otherwise(0)  # a mark of the same day counts
    window = Window.partitionBy(*keys) if keys else Window.partitionBy()
    order = (F.col("__date").desc(), side) if forward else (F.col("__date"), side)
    found = F.last("__mark", ignorenulls=True).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.when(F.col(left_date).isNotNull(), found)).where("__left").drop("__date", "__mark", "__left")


def distances(rows: DataFrame, marks: DataFrame, keys: list[str], date: str, mark: str) -> DataFrame:
    """``rows`` with since (days from the latest mark on or before their date) and until (days to the first mark after it);
    null where there is none. A mark on the day itself is the latest, not the next."""
    found = asof(rows, marks, keys, date, mark, name="__last").withColumn("__after", F.date_add(date, 1))
    found = asof(found, marks, keys, "__after", mark, forward=True, name="__next")
    return found.withColumn("since", F.datediff(date, "__last")).withColumn("until", F.datediff("__next", date)).drop("__last", "__after", "__next")


def next_on_calendar(dates: DataFrame, calendar: DataFrame, date: str, name: str = "rolled") -> DataFrame:
    """date and the first calendar day (column ``date`` of ``calendar``) on or after it, for each distinct date."""
    return asof(dates.select(date).where(F.col(date).isNotNull()).distinct(), calendar, [], date, "date", forward=True, name=name)


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: str, default=None) -> DataFrame:
    """``value`` with gaps filled by the last one before, and ``default`` before the first."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(value, ignorenulls=True).over(window)
    return rows.withColumn(value, filled if default is None else F.coalesce(filled, F.lit(default)))
