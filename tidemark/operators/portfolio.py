"""Calendar-time portfolios of overlapping positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Periods a year for annualisation; the source leaves it open. 252 trading days, or 52 for weekly bars.
PERIODS = 252
COST = 0.0020


def daily(positions: DataFrame, panel: DataFrame, hold: int, cost: float = COST, sign: int = 1) -> DataFrame:
    """date, n_open, ret: mean over open positions (ticker, pos: observation of entry) of stock less market on the ``hold``
    observations after entry, with the cost of each side on the first and last day."""
    days = positions.select("ticker", "pos", F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("k")).withColumn("idx", F.col("pos") + F.col("k"))
    sides = F.when(F.col("k") == 1, cost).otherwise(0.0) + F.when(F.col("k") == hold, cost).otherwise(0.0)
    rows = days.join(panel, ["ticker", "idx"]).withColumn("r", sign * (F.col("stock") - F.col("market")) - sides)
    return rows.groupBy("date").agg(F.count("*").alias("n_open"), F.avg("r").alias("ret"))


def summary(days: DataFrame, periods: int = PERIODS, by: list[str] | None = None) -> DataFrame:
    """n, mean, Sharpe ratio (annualised) and hit rate."""
    sharpe = F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * math.sqrt(periods)
    return days.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), sharpe.alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"))


def drawdown(days: DataFrame) -> DataFrame:
    """date, equity (cumulative log return) and its fall from the highest so far. One row a trading day, so one window will do."""
    up_to = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    with_equity = days.withColumn("equity", F.sum("ret").over(up_to))
    return with_equity.withColumn("drawdown", F.col("equity") - F.greatest(F.max("equity").over(up_to), F.lit(0.0))).select("date", "equity", "drawdown")
