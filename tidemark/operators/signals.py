"""Rule-based decisions with a log of what was skipped and why: entry gates, exits, the ledger and its replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import share_size
from ..functions.text import folded
from .asof import asof, next_on_calendar

# The frozen rules.
LEAST_CONSIDERATION = 1_000_000
MOST_STALE_DAYS = 5
CLEAN_DAYS = 30
DEDUPE_DAYS = 30
MOST_OPEN = 12
HOLD_DAYS = 63
POSITION_SIZE = 10_000
HEDGE_THRESHOLD = 5_000
# End of fixed values.


def person(name: Column) -> Column:
    """The key of a person in the gates: stripped and case-folded."""
    return folded(F.trim(F.coalesce(name, F.lit(""))))


def gated(filings: DataFrame, results: DataFrame, today: Column, least=LEAST_CONSIDERATION, stale=MOST_STALE_DAYS, clean=CLEAN_DAYS) -> DataFrame:
    """Filings (ticker, director, filed, consideration) with gap (days since the ticker's last result) and the reason of the
    first of the four gates that depend on the row alone: SIZE, STALE, NO_RESULTS, NOT_CLEAN; null if it passes them."""
    rows = filings.withColumn("ticker", F.upper("ticker"))
    rows = asof(rows, results.select(F.upper("ticker").alias("ticker"), "d"), ["ticker"], "filed", "d", name="last_result")
    gap = F.datediff("filed", "last_result")
    reason = (
        F.when(F.col("consideration").isNull() | (F.col("consideration") < least), "SIZE")
        .when(F.datediff(today, F.col("filed")) > stale, "STALE")
        .when(gap.isNull(), "NO_RESULTS")
        .when(gap <= clean, "NOT_CLEAN")
    )
    return rows.withColumn("gap", gap).withColumn("reason", reason).drop("last_result")


def select_entries(candidates: DataFrame, open_positions: DataFrame, recent: DataFrame, most_open: int = MOST_OPEN, days: int = DEDUPE_DAYS) -> DataFrame:
    """Decide ``gated`` filings: action ENTER or SKIP_<reason>.

    The last three gates depend on the entries before: DUPLICATE (the key entered within ``days``), ALREADY_OPEN, CAP (no
    slot). Filings go by (filed, ticker, director, consideration). Keys without a chance of entering never reach the fold
    over the others: within a key only the first filing not deduplicated by its history can be first, and it is open from
    then on; so the fold holds one filing per key, and the rest of a key is decided from its first entry. At most
    ``most_open`` entries are made, so entries are found by a sort and a limit instead of a walk.
    """
    key = F.struct(F.upper("ticker").alias("t"), person(F.col("director")).alias("d"))
    slots = most_open - open_positions.count()
    passed = candidates.where("reason is null").withColumn("__key", key)
    opened = open_positions.select(key.alias("__key")).distinct().withColumn("__open", F.lit(True))
    last = recent.select(key.alias("__key"), F.col("last_filed").alias("__last")).groupBy("__key").agg(F.max("__last").alias("__last"))
    passed = passed.join(opened, "__key", "left").join(last, "__key", "left")
    stale_copy = F.col("__last").isNotNull() & (F.datediff("filed", "__last") <= days)
    passed = passed.withColumn("__reason", F.when(stale_copy, "DUPLICATE").when(F.col("__open"), "ALREADY_OPEN"))
    order = [F.col("filed"), F.upper("ticker"), F.col("director"), F.col("consideration")]
    place = F.struct(F.col("filed").alias("f"), F.upper("ticker").alias("t"), F.col("director").alias("d"), F.col("consideration").alias("c"))
    free = passed.where("__reason is null").groupBy("__key").agg(F.min(place).alias("__first"))
    taken = free.orderBy("__first").limit(max(0, slots)).withColumn("__taken", F.lit(True))
    ranked = passed.join(taken, "__key", "left").withColumn("__place", place)
    # of equal rows the first enters and the others are its duplicates
    copy = F.row_number().over(Window.partitionBy("__key", "__place").orderBy(*order))
    ranked = ranked.withColumn("__copy", copy)
    own = F.coalesce(F.col("__taken"), F.lit(False))
    entered = F.col("__reason").isNull() & own & (F.col("__place") == F.col("__first")) & (F.col("__copy") == 1)
    after = own & ((F.col("__place") > F.col("__first")) | (F.col("__place") == F.col("__first")) & (F.col("__copy") > 1))
    near = after & (F.datediff("filed", F.col("__first")["f"]) <= days)
    reason = F.when(entered, F.lit(None)).when(F.col("__reason") == "DUPLICATE", "DUPLICATE").when(near, "DUPLICATE").when(F.col("__reason").isNotNull() | after, "ALREADY_OPEN").otherwise("CAP")
    decided = ranked.withColumn("reason", reason).withColumn("action", F.when(entered, "ENTER").otherwise(F.concat(F.lit("SKIP_"), F.col("reason"))))
    skipped = candidates.where("reason is not null").withColumn("action", F.concat(F.lit("SKIP_"), F.col("reason")))
    columns = ["ticker", "director", "filed", "consideration", "gap", "action"]
    return decided.select(*columns).unionByName(skipped.select(*columns))


def exits_due(open_positions: DataFrame, calendar: DataFrame, today, hold: int = HOLD_DAYS) -> DataFrame:
    """Positions whose ``hold``-th trading day has come by ``today`` (a date), which rolls forward to a trading day; none if
    there is no such day. An entry off the calendar counts from the next day on it. ``calendar``: date, ordinal."""
    rolled = next_on_calendar(open_positions, calendar, "entry_date", "__day")
    entry = rolled.join(calendar.select(F.col("date").alias("__day"), F.col("ordinal").alias("__from")), "__day")
    now = calendar.where(F.col("date") >= F.lit(today)).agg(F.min("ordinal").alias("n")).first()["n"]
    if now is None:
        return open_positions.limit(0)
    due = entry.where(F.lit(now) - F.col("__from") >= hold).select("entry_date").distinct()
    return open_positions.join(due, "entry_date", "left_semi")


def replay(ledger: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(open positions, last filed date per key) of a mode's ledger. Here a director's key is only lower-cased, as ledgers
    are written from keys already stripped."""
    rows = ledger.where(F.col("mode") == mode).withColumn("director", F.lower(F.coalesce("director", F.lit(""))))
    entered = rows.where(F.col("action").isin("ENTER", "DRY_ENTER"))
    exited = rows.where(F.col("action").isin("EXIT", "DRY_EXIT"))
    key = ["ticker", "director", "entry_date"]
    positions = entered.where("entry_date is not null").select(*key).distinct().join(exited.select(*key), key, "left_anti")
    recent = entered.where("filed_date is not null").groupBy(F.upper("ticker").alias("ticker"), "director").agg(F.max("filed_date").alias("last_filed"))
    return positions, recent


def ledger_rows(decided: DataFrame, due: DataFrame, at: Column, mode: str, price: Column | None = None) -> DataFrame:
    """What a dry run appends: one row per decision and per exit."""
    p = F.lit(None).cast("double") if price is None else price
    qty = F.when(F.col("action") == "ENTER", share_size(F.lit(POSITION_SIZE), p))
    made = decided.select(at.alias("ts"), F.lit(mode).alias("mode"), F.when(F.col("action") == "ENTER", "DRY_ENTER").otherwise(F.col("action")).alias("action"), "ticker", "director", F.col("filed").alias("filed_date"), F.lit(None).cast("date").alias("entry_date"), qty.alias("qty"))
    out = due.select(at.alias("ts"), F.lit(mode).alias("mode"), F.lit("DRY_EXIT").alias("action"), "ticker", "director", F.lit(None).cast("date").alias("filed_date"), "entry_date", F.lit(None).cast("long").alias("qty"))
    return made.unionByName(out)


def hedge_order(n_open: Column, held: Column, price: Column, size: int = POSITION_SIZE, threshold: int = HEDGE_THRESHOLD) -> Column:
    """Index shares to trade so that shorts are hedged; 0 while the gap is worth no more than the threshold."""
    target = F.floor(F.try_divide(n_open * size, price))
    change = target - held
    return F.when(F.abs(change) * price > threshold, change).otherwise(0).cast("long")
