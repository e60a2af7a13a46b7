"""Bars to returns: calendar ordinals, calendar-adjacent log returns, alignment with the index, coverage, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calendar(bars: DataFrame) -> DataFrame:
    """date, ordinal from 0 of every date that any ticker has. One row a trading day, so it is small whatever the bars are."""
    return bars.select("date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)


def calendar_returns(bars: DataFrame, price: str = "adj_close") -> DataFrame:
    """ticker, date, ret: log returns between neighbours of the calendar. A missing bar leaves out its own return and the
    next day's, so no return spans a gap; prices that are null or not positive count as missing."""
    good = bars.where(F.col(price) > 0).select("ticker", "date", F.col(price).alias("p"))
    days = calendar(good)
    with_days = good.join(F.broadcast(days), "date")  # the calendar: one small row per trading day
    window = Window.partitionBy("ticker").orderBy("ordinal")
    lagged = with_days.withColumn("p0", F.lag("p").over(window)).withColumn("o0", F.lag("ordinal").over(window))
    return lagged.where("ordinal - o0 = 1").select("ticker", "date", F.ln(F.col("p") / F.col("p0")).alias("ret"))


def aligned(returns: DataFrame, index: str) -> DataFrame:
    """ticker, date, stock, market, idx: days on which both have a return, numbered from 0 for each ticker."""
    market = returns.where(F.col("ticker") == index).select("date", F.col("ret").alias("market"))
    stocks = returns.where(F.col("ticker") != index).select("ticker", "date", F.col("ret").alias("stock"))
    both = stocks.join(F.broadcast(market), "date")  # one row per trading day
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def coverage(bars: DataFrame, universe: DataFrame, index: str, share: float = 0.90) -> DataFrame:
    """ticker, rows, status for every ticker of the universe: empty, short (fewer than the share of the index's days, rounded
    down) or ok."""
    counts = bars.groupBy("ticker").agg(F.count("*").alias("rows"))
    days = bars.where(F.col("ticker") == index).agg(F.count("*").alias("n")).first()["n"]
    if not days:
        raise ValueError("the index has no bars")
    least = int(share * days)
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    status = F.when(rows == 0, "empty").when(rows < least, "short").otherwise("ok")
    return universe.select("ticker").distinct().join(counts, "ticker", "left").select("ticker", rows.alias("rows"), status.alias("status"))


def trailing_features(panel: DataFrame, momentum: int = 126, volatility: int = 63, high: int = 252, moves: int = 63) -> DataFrame:
    """Per observation of an aligned panel, known on its day: momentum (stock less market over the ``momentum`` observations
    before it), volatility and distance from the high (over ``volatility`` and ``high`` observations, itself included), mean
    size of a move (over the ``moves`` before it). At the start frames are as long as there are observations; lengths are of
    daily bars, and half a year of weekly ones is 26."""
    window = Window.partitionBy("ticker").orderBy("idx")
    excess = F.col("stock") - F.col("market")
    level = F.sum("stock").over(window.rowsBetween(Window.unboundedPreceding, 0))
    panel = panel.withColumn("level", level)
    top = F.max("level").over(window.rowsBetween(1 - high, 0))
    return panel.select(
        "ticker", "date", "idx",
        F.sum(excess).over(window.rowsBetween(-momentum, -1)).alias("momentum"),
        F.stddev_samp("stock").over(window.rowsBetween(1 - volatility, 0)).alias("volatility"),
        (F.col("level") - top).alias("from_high"),
        F.avg(F.abs("stock")).over(window.rowsBetween(-moves, -1)).alias("mean_abs"),
    )


def forward_car(panel: DataFrame, days: int) -> DataFrame:
    """ticker, date, idx, car: stock less market over the next ``days`` observations, only where all of them exist."""
    ahead = Window.partitionBy("ticker").orderBy("idx").rowsBetween(1, days)
    found = panel.withColumn("car", F.sum(F.col("stock") - F.col("market")).over(ahead)).withColumn("__n", F.count("stock").over(ahead))
    return found.where(F.col("__n") == days).select("ticker", "date", "idx", "car")


def forward_coverage(panel: DataFrame, days: int) -> DataFrame:
    """ticker, n, left_out: the observations of a ticker, and how many have fewer than ``days`` after them, so that
    ``forward_car`` has no row for them. Observations are numbered without gaps, so a count tells."""
    counts = panel.groupBy("ticker").agg(F.count("*").alias("n"))
    return counts.select("ticker", "n", F.least("n", F.lit(days).cast("long")).alias("left_out"))


def peer_excess(returns: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Return less the mean of the group's other members on the day, null for groups of fewer than ``least``."""
    window = Window.partitionBy(group, "date")
    n, total = F.count("ret").over(window), F.sum("ret").over(window)
    return returns.withColumn("peers", F.when(n >= least, F.try_divide(total - F.col("ret"), n - 1))).withColumn("excess", F.col("ret") - F.col("peers"))
