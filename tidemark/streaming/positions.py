"""Positions over time: the daily run as a stream with state, in which exits free slots that later runs fill.

A run happens on each trading day. It sees the filings of the last days that passed the gates of their own row, decides
them in order against the book (what is open, what was entered lately, how many slots are left), and closes what has been
held long enough; a position that is due still takes its slot in the run that closes it.

Only the book needs an order over all filings, so only what can change it goes there: of each run the first keys in order,
as many as could enter if all keys that the book may block came first. That is one short row a trading day, however many
filings there are. What each filing was told follows from the positions by a join on key and day.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.signals import DEDUPE_DAYS, HOLD_DAYS, MOST_OPEN, MOST_STALE_DAYS, person

#: Keeps state in columns that can be read back; the default provider has no state by variables.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FILING = "filed date, ticker string, director string, consideration decimal(18,2), key string"
RUNS = f"book string, ordinal long, date date, rows array<struct<{FILING.replace(' ', ': ').replace(',: ', ', ')}>>"
EVENTS = "book string, date date, action string, ticker string, director string, filed date, consideration decimal(18,2), key string, entry_date date"
_HELD = "ticker string, director string, filed date, consideration decimal(18,2), key string, ordinal long, entry_date date, open boolean"


def keys_to_walk(most_open: int, days: int, stale: int, hold: int) -> int:
    """Keys of a run that suffice: those that may fill the slots, those that can be open, and those that can be closed but
    entered too lately. An entry bars its key from filings up to ``days`` later, which runs see up to ``stale`` days after;
    in that time a slot is filled again every ``hold`` runs and one at most."""
    return most_open * (2 + math.ceil((days + stale + 1) / (hold + 1)))


def runs(filings: DataFrame, calendar: DataFrame, book: str = "dry", most_open: int = MOST_OPEN, days: int = DEDUPE_DAYS, stale: int = MOST_STALE_DAYS, hold: int = HOLD_DAYS) -> DataFrame:
    """One row for each day of ``calendar`` (date, ordinal): the filings that its run has to walk, in order.

    ``filings`` (ticker, director, filed, consideration) have passed the gates of their row but for staleness: a run sees
    those filed up to ``stale`` days before. Of a key's filings of one day the first decides, as the others meet its result.
    Filings without a date are in no run.
    """
    place = F.struct("filed", F.upper("ticker").alias("ticker"), "director", F.col("consideration").cast("decimal(18,2)").alias("consideration"), _key().alias("key"))
    firsts = filings.where("filed is not null").groupBy(_key().alias("key"), "filed").agg(F.min(place).alias("row"))
    seen = firsts.withColumn("date", F.explode(F.sequence("filed", F.date_add("filed", stale))))
    of_key = seen.join(calendar.select("date"), "date", "left_semi").groupBy("date", "key").agg(F.sort_array(F.collect_list("row")).alias("own"))
    order = F.row_number().over(Window.partitionBy("date").orderBy(F.element_at("own", 1)))
    walked = of_key.withColumn("n", order).where(F.col("n") <= keys_to_walk(most_open, days, stale, hold))
    lists = walked.groupBy("date").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("rows"))
    none = F.array().cast(lists.schema["rows"].dataType)
    return calendar.join(lists, "date", "left").select(F.lit(book).alias("book"), F.col("ordinal").cast("long").alias("ordinal"), "date", F.coalesce("rows", none).alias("rows"))


def _key():
    return F.concat_ws("|", F.upper("ticker"), person(F.col("director")))


class Book(StatefulProcessor):
    """State of one book: what is open or was entered lately, and the last run. Both are bounded by slots and days.

    Runs of a batch go in order of their ordinals. One at or before the last run done has been decided and is left out, so
    days that are delivered again change nothing.
    """

    def __init__(self, most_open: int, days: int, stale: int, hold: int):
        self.most_open, self.days, self.stale, self.hold = most_open, days, stale, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _HELD)
        self.last = handle.getValueState("last", "ordinal long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _HELD.replace("(18,2)", "").split(", ")]
        held = [dict(zip(names, r, strict=True)) for r in self.held.get()] if self.held.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        found = []
        for run in sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["ordinal"]):
            if last is None or run["ordinal"] > last:
                last, today = int(run["ordinal"]), pd.Timestamp(run["date"]).date()
                held, events = self.decide(held, last, today, run["rows"])
                found += [(key[0], today, *e) for e in events]
        if last is not None:
            self.last.update((last,))
        if held:
            self.held.put([tuple(p[n] for n in names) for p in held])
        else:
            self.held.clear()
        yield pd.DataFrame(found, columns=[c.split()[0] for c in EVENTS.replace("(18,2)", "").split(", ")])

    def decide(self, held: list[dict], ordinal: int, today, filings) -> tuple[list[dict], list[tuple]]:
        """The book after a run, and its entries and exits."""
        due = [p for p in held if p["open"] and ordinal - p["ordinal"] >= self.hold]
        taken = {p["key"] for p in held if p["open"]}
        slots = self.most_open - sum(p["open"] for p in held)
        entered: dict = {}
        for p in held:
            entered[p["key"]] = max(p["filed"], entered.get(p["key"], p["filed"]))
        events, new = [], []
        for f in filings:
            if slots <= 0:
                break
            filed, key = f["filed"], f["key"]
            if key in taken or (key in entered and (filed - entered[key]).days <= self.days):
                continue
            new.append({"ticker": f["ticker"], "director": f["director"], "filed": filed, "consideration": f["consideration"], "key": key, "ordinal": ordinal, "entry_date": today, "open": True})
            events.append(("ENTER", f["ticker"], f["director"], filed, f["consideration"], key, today))
            taken.add(key)
            entered[key] = filed
            slots -= 1
        for p in due:
            p["open"] = False
            events.append(("EXIT", p["ticker"], p["director"], p["filed"], p["consideration"], p["key"], p["entry_date"]))
        return [p for p in held + new if p["open"] or (today - p["filed"]).days <= self.days + self.stale], events

    def close(self) -> None:
        pass


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RUNS).parquet(folder)


def book_events(run_rows: DataFrame, most_open: int = MOST_OPEN, days: int = DEDUPE_DAYS, stale: int = MOST_STALE_DAYS, hold: int = HOLD_DAYS) -> DataFrame:
    """The entries and exits of a stream of ``runs``; each book goes by itself. Needs a session with ``STORE``."""
    return run_rows.groupBy("book").transformWithStateInPandas(Book(most_open, days, stale, hold), EVENTS, "Append", "None")


def held_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The book as a checkpoint has it: what is open or was entered lately, and the run that entered it."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.select(F.col("key.book").alias("book"), "list_element.*")


def positions(events: DataFrame) -> DataFrame:
    """A row a position from its entry and exit: book, key, ticker, director, filed, consideration, entry_date, exit_date (null if open)."""
    same = ["book", "key", "ticker", "director", "filed", "consideration", "entry_date"]
    return events.groupBy(*same).agg(F.max(F.when(F.col("action") == "EXIT", F.col("date"))).alias("exit_date"))


def told(filings: DataFrame, calendar: DataFrame, held: DataFrame, days: int = DEDUPE_DAYS, stale: int = MOST_STALE_DAYS) -> DataFrame:
    """What each run told the filings that it saw: date, ticker, director, filed, consideration, action (ENTER,
    SKIP_DUPLICATE, SKIP_ALREADY_OPEN, SKIP_CAP), n. Equal filings are one row with their number; of those that enter one
    does, and the others are its duplicates. ``held``: ``positions`` of one book.

    A filing is told by the positions of its key around the day. Those are spread over the days on which they matter, a row
    a key and day, so that this is one join on both.
    """
    end = calendar.agg(F.max("date")).first()[0]
    matters = F.when(F.col("exit_date").isNull(), F.lit(end)).otherwise(F.greatest("exit_date", F.date_add("filed", days + stale)))
    spread = held.withColumn("date", F.explode(F.sequence("entry_date", F.greatest("entry_date", matters))))
    before = F.col("date") > F.col("entry_date")
    by_day = spread.groupBy(F.col("key").alias("__key"), "date").agg(
        F.max(F.when(before, F.col("filed"))).alias("__prior"),
        F.max(before & (F.col("exit_date").isNull() | (F.col("date") <= F.col("exit_date")))).alias("__open"),
        F.max(F.when(~before, F.struct("filed", "ticker", "director", "consideration"))).alias("__own"),
    )
    amount = F.col("consideration").cast("decimal(18,2)").alias("consideration")
    alike = filings.where("filed is not null").groupBy(_key().alias("__key"), "filed", F.upper("ticker").alias("ticker"), "director", amount).agg(F.count("*").alias("n"))
    seen = alike.withColumn("date", F.explode(F.sequence("filed", F.date_add("filed", stale)))).join(calendar.select("date"), "date", "left_semi")
    rows = seen.withColumn("__place", F.struct("filed", "ticker", "director", "consideration")).join(by_day, ["__key", "date"], "left")
    own = F.col("__own")
    enters, after = F.col("__place") == own, F.col("__place") > own
    prior = F.when(after, own["filed"]).otherwise(F.col("__prior"))
    skip = F.when(F.datediff("filed", prior) <= days, "SKIP_DUPLICATE").when(after | F.col("__open"), "SKIP_ALREADY_OPEN").otherwise("SKIP_CAP")
    one = lambda action, n: F.struct(action.alias("action"), n.alias("n"))
    both = F.when(enters, F.array(one(F.lit("ENTER"), F.lit(1).cast("long")), one(F.lit("SKIP_DUPLICATE"), F.col("n") - 1))).otherwise(F.array(one(skip, F.col("n"))))
    return rows.select("date", "ticker", "director", "filed", "consideration", F.inline(both)).where("n > 0")
