"""Placebo draws, bootstrap, permutation and controls. Draws come from a counter-based generator: bits of the MD5 of seed, draw and
key, which any engine can compute, so results repeat on any cluster and can be checked in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from .asof import asof


def random_bits(digits: int, *seed: Column | int) -> Column:
    """4 * ``digits`` bits, at most 60, of the MD5 of the seeds, as text with colons between."""
    columns = [(s if isinstance(s, Column) else F.lit(s)).cast("string") for s in seed]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, digits), 16, 10).cast("long")


def pick(n: Column | int, *seed: Column | int) -> Column:
    """An integer from 0 to ``n`` - 1, each as likely but for 2**-32, by the seeds; ``n`` is below 2**31."""
    return F.shiftright(random_bits(8, *seed) * (n if isinstance(n, Column) else F.lit(n)).cast("long"), 32)


def placebo(events: DataFrame, panel_values: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """draw, mean: for each draw every event (ticker, event_id) takes the value of a random observation of its ticker.
    ``panel_values``: ticker, i from 0, value. Draws are a sequence per event; what is drawn is counted before the shuffle, and
    values meet the counts by equi-join."""
    sizes = panel_values.groupBy("ticker").agg(F.count("*").alias("n"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = events.select("ticker", "event_id").repartition(parts, "event_id")  # a file of few events is much work: of each ``draws`` hashes
    drawn = spread.join(F.broadcast(sizes), "ticker").select("ticker", "event_id", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    # a pick is never null; told so, the plan need not compute each twice to leave nulls out
    drawn = drawn.withColumn("i", F.coalesce(pick(F.col("n"), seed, F.col("draw"), F.col("event_id")), F.lit(-1)))
    times = drawn.groupBy("draw", "ticker", "i").agg(F.count("*").alias("__n"))
    mean = F.try_divide(F.sum(F.col("value") * F.col("__n")), F.sum(F.when(F.col("value").isNotNull(), F.col("__n"))))
    return times.join(panel_values, ["ticker", "i"]).groupBy("draw").agg(mean.alias("mean"))


def poisson_bootstrap(rows: DataFrame, value: str, key: Column, draws: int, seed: int = 1) -> DataFrame:
    """draw, mean: each row counts a Poisson(1) number of times in each draw, which needs no sampling by position and so
    combines before the shuffle. Rows with the same key, such as those of a cluster, count alike."""
    u = random_bits(8, seed, F.col("draw"), key).cast("double") / float(1 << 32)
    # cumulative probabilities of Poisson(1)
    edges = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    times = sum((u >= e).cast("int") for e in edges)
    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__w", times)
    return many.groupBy("draw").agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("mean"))


def interval(draws: DataFrame, real: float | None, level: float = 0.95) -> DataFrame:
    """draws, lower, upper, percentile: the values of the draws at the exact ranks that leave (1 - ``level``) / 2 on either side, and
    the share of the draws at or below ``real``. One row a draw is sorted, so it is bounded by their number."""
    tail = (1 - level) / 2
    values, n = F.sort_array(F.collect_list("mean")), F.count("mean")
    at = lambda share: F.get(values, F.greatest(F.ceil(F.round(share * n, 9)) - 1, F.lit(0)).cast("int"))
    share = F.avg((F.col("mean") <= F.lit(real)).cast("double"))
    return draws.agg(n.alias("draws"), at(F.lit(tail)).alias("lower"), at(F.lit(1 - tail)).alias("upper"), share.alias("percentile"))


#: Ranges of hashes that a draw's labels are counted in: of 60 bits the first 12 say which.
HASH_RANGES = 4096


def permutation(rows: DataFrame, value: str, label: Column, key: Column, draws: int, seed: int = 1) -> DataFrame:
    """draw, difference: the labels are shuffled, so in each draw as many rows have one as in truth: those of the least hashes.
    Rows without a value take no part; ``key`` tells rows apart.

    Ranges of hashes are summed first; a draw's cut falls into one range, and only that range's rows are put in order.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("__v"), label.cast("int").alias("__l"), key.cast("string").alias("__key"))
    known = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("__l"), F.lit(0)).alias("k")).first()
    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__h", random_bits(15, seed, F.col("draw"), F.col("__key")))
    many = many.withColumn("__r", F.shiftright("__h", 48))
    sums = many.groupBy("draw", "__r").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    before = Window.partitionBy("draw").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # HASH_RANGES rows a draw
    placed = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    whole = F.col("__before") + F.col("__n") <= known["k"]
    totals = placed.groupBy("draw").agg(F.sum("__s").alias("__all"), F.sum(F.when(whole, F.col("__s"))).alias("__below"))
    cut = placed.where(~whole & (F.col("__before") < known["k"])).select("draw", "__r", (F.lit(known["k"]) - F.col("__before")).alias("__need"))
    place = F.row_number().over(Window.partitionBy("draw", "__r").orderBy("__h", "__key"))
    part = many.join(F.broadcast(cut), ["draw", "__r"]).withColumn("__i", place).where("__i <= __need")  # a row a draw
    found = totals.join(part.groupBy("draw").agg(F.sum("__v").alias("__part")), "draw", "left")
    own = F.coalesce("__below", F.lit(0)) + F.coalesce("__part", F.lit(0))
    mean = lambda total, n: F.try_divide(total, F.nullif(F.lit(float(n)), F.lit(0.0)))
    return found.select("draw", (mean(own, known["k"]) - mean(F.col("__all") - own, known["n"] - known["k"])).alias("difference"))


def nearest_match(treated: DataFrame, pool: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """For each treated row the pool row of the same ``by`` whose value is nearest, with replacement, ties to the least key.

    The nearest value below and the nearest above come from as-of scans in both directions, so no pairs are formed beyond
    those two.
    """
    lows = pool.groupBy(*by, value).agg(F.min(key).alias("__k"))
    both = treated.withColumn("__side", F.lit(1)).unionByName(lows.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    mark = F.when(F.col("__side") == 0, F.struct(F.col(value).alias("v"), F.col("__k").alias("k")))
    up = Window.partitionBy(*by).orderBy(value, "__side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.col(value).desc(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__below", F.last(mark, ignorenulls=True).over(up)).withColumn("__above", F.last(mark, ignorenulls=True).over(down)).where("__side = 1")
    gap = lambda c: F.abs(F.col(c)["v"] - F.col(value))
    below = F.col("__above").isNull() | (gap("__below") < gap("__above")) | (gap("__below") == gap("__above")) & (F.col("__below")["k"] <= F.col("__above")["k"])
    chosen = F.when(F.col("__below").isNotNull() & below, F.col("__below")).otherwise(F.col("__above"))
    return found.withColumn("match", chosen["k"]).withColumn("match_value", chosen["v"]).where("match is not null").drop("__side", "__k", "__below", "__above")


def clear_of_events(windows: DataFrame, events: DataFrame, by: list[str], day: str, event_day: str, days: int = 91) -> DataFrame:
    """The windows with no event of the same ``by`` within ``days`` calendar days on either side of ``day``, by an as-of scan each way."""
    near = asof(windows, events, by, day, event_day, name="__before")
    near = asof(near, events, by, day, event_day, forward=True, name="__after")
    far = lambda a, b: F.coalesce(F.datediff(b, a) > days, F.lit(True))
    return near.where(far("__before", day) & far(day, "__after")).drop("__before", "__after")


def disjoint(windows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Of the windows of each ``by`` as many as can be had without two that share a day: by earliest end, then latest start, each
    that starts after the last one chosen has ended. Windows without a start or an end are left out. A group has a window a
    trading day at most, so its fold is one row's work."""
    names = [F.col(c) for c in windows.columns if c not in by]
    item = F.struct(F.col(end).alias("__end"), (-F.unix_date(start)).alias("__late"), F.struct(*names).alias("w"))
    known = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).withColumn("__x", item)
    kind = known.schema["__x"].dataType
    none = F.struct(F.lit(None).cast(windows.schema[end].dataType).alias("last"), F.array().cast(ArrayType(kind)).alias("chosen"))
    step = lambda s, x: F.when(s["last"].isNull() | (x["w"][start] > s["last"]), F.struct(x["__end"].alias("last"), F.array_append(s["chosen"], x).alias("chosen"))).otherwise(s)
    folded = known.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list("__x")), none, step)["chosen"].alias("__c"))
    return folded.select(*by, F.inline(F.transform("__c", lambda x: x["w"]))).select(*windows.columns)
