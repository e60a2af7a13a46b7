"""Event studies as one logical plan over (event, day) rows: market model, abnormal returns, and the tests over events.

An event is a (ticker, day 0) pair with a weight: how many announcements share it. Windows count the ticker's own
observations. What an event lacks is told in ``skip_reason`` and never silently dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import tradeable_date
from .asof import next_on_calendar

ESTIMATION, EVENT = (-120, -21), (-5, 20)
#: A market that moves less than this over the estimation window explains nothing.
LEAST_MARKET_SS = 1e-18


def day_zero(announcements: DataFrame, calendar: DataFrame) -> DataFrame:
    """``announcements`` with day0: the first calendar day on which each could be traded; null past the calendar."""
    dated = announcements.withColumn("__d", tradeable_date(F.col("announced_at")))
    rolled = next_on_calendar(dated, calendar, "__d", "day0")  # one row per distinct date
    return dated.join(F.broadcast(rolled), "__d", "left").drop("__d")


def events(announcements: DataFrame, panel: DataFrame, estimation=ESTIMATION, event=EVENT) -> DataFrame:
    """ticker, day0, weight, pos, skip_reason: no_prices (the ticker has none), no_day0 (no observation on day 0, or none
    at all later), window (it runs off the data). A fit depends on nothing but ticker and day 0, so each is fitted once."""
    weights = announcements.groupBy("ticker", "day0").agg(F.count("*").alias("weight"))
    known = panel.groupBy("ticker").agg(F.max("idx").alias("last"))
    places = panel.select("ticker", F.col("date").alias("day0"), F.col("idx").alias("pos"))
    found = weights.join(known, "ticker", "left").join(places, ["ticker", "day0"], "left")
    off = (F.col("pos") + estimation[0] < 0) | (F.col("pos") + event[1] > F.col("last"))
    reason = F.when(F.col("last").isNull(), "no_prices").when(F.col("pos").isNull(), "no_day0").when(off, "window")
    return found.withColumn("skip_reason", reason).drop("last")


def windows(studied: DataFrame, panel: DataFrame, estimation=ESTIMATION, event=EVENT) -> DataFrame:
    """One row per event and day of its windows: an equi-join on (ticker, observation), as offsets are exploded first."""
    offsets = F.concat(F.sequence(F.lit(estimation[0]), F.lit(estimation[1])), F.sequence(F.lit(event[0]), F.lit(event[1])))
    days = studied.where("skip_reason is null").select("ticker", "day0", "weight", "pos", F.explode(offsets).alias("rel_day"))
    return days.withColumn("idx", F.col("pos") + F.col("rel_day")).join(panel.select("ticker", "idx", "stock", "market"), ["ticker", "idx"]).drop("idx", "pos")


MODEL = ("alpha", "beta", "residual_std", "market_mean", "market_ss", "n_obs")


def fitted(days: DataFrame, estimation=ESTIMATION) -> DataFrame:
    """Days with their event's market model: alpha, beta, residual_std (n - 2), market_mean, market_ss, n_obs. Residuals are
    summed in a second pass, as a perfect fit must give zero. Degenerate fits have null beta.

    The fit is a window over the event's days rather than an aggregate joined back, so days are computed and dealt once;
    an event has as many days as its windows are long.
    """
    event = Window.partitionBy("ticker", "day0")
    inside = F.col("rel_day").between(*estimation)
    stock, market = F.when(inside, F.col("stock")), F.when(inside, F.col("market"))
    rows = days.withColumns({
        "n_obs": F.count(stock).over(event), "market_mean": F.avg(market).over(event), "market_ss": F.regr_sxx(stock, market).over(event),
        "beta": F.regr_slope(stock, market).over(event), "alpha": F.regr_intercept(stock, market).over(event),
    })
    good = (F.col("n_obs") >= 3) & (F.col("market_ss") >= LEAST_MARKET_SS)
    rows = rows.withColumns({"beta": F.when(good, F.col("beta")), "alpha": F.when(good, F.col("alpha"))})
    rows = rows.withColumn("ar", F.col("stock") - F.col("alpha") - F.col("beta") * F.col("market"))
    rss = F.sum(F.when(inside, F.col("ar") * F.col("ar"))).over(event)
    return rows.withColumn("residual_std", F.sqrt(F.try_divide(rss, F.col("n_obs") - 2)))


def market_model(days: DataFrame, estimation=ESTIMATION) -> DataFrame:
    """ticker, day0 and the model of each event."""
    return fitted(days, estimation).where(F.col("rel_day") == estimation[0]).select("ticker", "day0", *MODEL)


def abnormal(days: DataFrame, estimation=ESTIMATION, event=EVENT) -> DataFrame:
    """Days with ar, sar (standardised by the forecast error, event days only) and Corrado's rank of ar within the event:
    ordinal, ties broken by day."""
    rows = fitted(days, estimation).where("beta is not null")
    factor = F.sqrt(1 + F.try_divide(F.lit(1.0), "n_obs") + F.pow(F.col("market") - F.col("market_mean"), 2) / F.col("market_ss"))
    rows = rows.withColumn("sar", F.when(F.col("rel_day").between(*event), F.try_divide("ar", F.col("residual_std") * factor)))
    rank = F.row_number().over(Window.partitionBy("ticker", "day0").orderBy("ar", "rel_day"))
    return rows.withColumn("rank", rank).select("ticker", "day0", "weight", "rel_day", "ar", "sar", "rank")


def caar(rows: DataFrame, event=EVENT) -> DataFrame:
    """rel_day, n, mean_ar, caar over all announcements."""
    by_day = rows.where(F.col("rel_day").between(*event)).groupBy("rel_day").agg(F.sum("weight").alias("n"), (F.sum(F.col("ar") * F.col("weight")) / F.sum("weight")).alias("mean_ar"))
    return by_day.withColumn("caar", F.sum("mean_ar").over(Window.orderBy("rel_day").rowsBetween(Window.unboundedPreceding, 0)))  # one row per event day


def bmp(rows: DataFrame, event=EVENT) -> DataFrame:
    """n, mean_scar, z of the standardised cumulative abnormal returns; z is null for one event or no spread."""
    length = event[1] - event[0] + 1
    scars = rows.where(F.col("rel_day").between(*event)).groupBy("ticker", "day0", "weight").agg((F.sum("sar") / math.sqrt(length)).alias("scar"))
    sums = scars.agg(F.sum("weight").alias("n"), F.sum(F.col("scar") * F.col("weight")).alias("s"), F.sum(F.col("scar") * F.col("scar") * F.col("weight")).alias("ss"))
    mean = F.col("s") / F.col("n")
    # scars are of order one, so the one-pass sum of squares is safe here, unlike that of returns
    std = F.sqrt(F.try_divide(F.greatest(F.col("ss") - F.col("n") * mean * mean, F.lit(0.0)), F.nullif(F.col("n") - 1, F.lit(0).cast("long"))))
    return sums.select("n", mean.alias("mean_scar"), F.try_divide(mean, F.nullif(std / F.sqrt("n"), F.lit(0.0))).alias("z"))


def corrado(rows: DataFrame, estimation=ESTIMATION, event=EVENT) -> DataFrame:
    """rel_day, mean_rank (less its expectation), z. Ordinal ranks of T days have variance (T^2 - 1) / 12 in each event."""
    days = estimation[1] - estimation[0] + event[1] - event[0] + 2
    own = rows.where(F.col("rel_day").between(*event))
    centred = F.col("rank") - (days + 1) / 2
    by_day = own.groupBy("rel_day").agg(F.sum("weight").alias("n"), (F.sum(centred * F.col("weight")) / F.sum("weight")).alias("mean_rank"))
    return by_day.select("rel_day", "mean_rank", (F.col("mean_rank") / F.sqrt(((days * days - 1) / 12) / F.col("n"))).alias("z"))


def study(announcements: DataFrame, panel: DataFrame, calendar: DataFrame, estimation=ESTIMATION, event=EVENT) -> DataFrame:
    """From announcements to abnormal returns."""
    studied = events(day_zero(announcements, calendar), panel, estimation, event)
    days = windows(studied, panel, estimation, event)
    return abnormal(days, estimation, event)


def report(studied: DataFrame) -> DataFrame:
    """skip_reason (studied where there is none) and how many announcements."""
    return studied.groupBy(F.coalesce("skip_reason", F.lit("studied")).alias("status")).agg(F.sum("weight").alias("n"))
