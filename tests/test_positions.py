"""The daily run over time: against a plain walk over all filings of all days, restarted, replayed and with few slots."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import positions, streams

START = date(2024, 1, 1)
RULES = {"most_open": 2, "days": 4, "stale": 2, "hold": 3}


def plain_walk(filings, days, most_open, days_apart, stale, hold):
    """All filings of all runs one by one: positions, and how many filings of a day were told what."""
    book, told = [], {}
    for o, today in enumerate(days):
        due = [p for p in book if p["exit"] is None and o - p["o"] >= hold]
        taken = {p["key"] for p in book if p["exit"] is None}
        slots, last = most_open - len(taken), {}
        for p in book:
            last[p["key"]] = max(p["filed"], last.get(p["key"], p["filed"]))
        for ticker, director, filed, amount in sorted((f for f in filings if 0 <= (today - f[2]).days <= stale), key=lambda f: (f[2], f[0].upper(), f[1], f[3])):
            key = (ticker.upper(), director.strip().lower())
            if key in last and (filed - last[key]).days <= days_apart:
                action = "SKIP_DUPLICATE"
            elif key in taken:
                action = "SKIP_ALREADY_OPEN"
            elif slots <= 0:
                action = "SKIP_CAP"
            else:
                action = "ENTER"
                book.append({"key": key, "filed": filed, "o": o, "entry": today, "exit": None})
                taken.add(key)
                last[key] = filed
                slots -= 1
            told[today, filed, key, action] = told.get((today, filed, key, action), 0) + 1
        for p in due:
            p["exit"] = today
    return sorted((p["key"], p["filed"], p["entry"], p["exit"] or date.max) for p in book), told


def random_filings(seed, n=220, span=60):
    rng = random.Random(seed)
    rows = [(rng.choice(["aaa", "AAA", "BBB", "CCC"]), rng.choice([" Ann Lee", "Ann Lee", "ANN LEE ", "Bo"]), START + timedelta(rng.randrange(span)), Decimal(rng.randrange(3))) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_a_plain_walk(spark, tmp_path, seed):
    filings = random_filings(seed)
    days = [START + timedelta(i) for i in range(60) if (START + timedelta(i)).weekday() < 5 and i % 11]
    calendar = spark.createDataFrame(list(zip(days, range(len(days)), strict=True)), "date date, ordinal long")
    rows = spark.createDataFrame([*filings, ("DDD", "Cy", None, Decimal(1))], "ticker string, director string, filed date, consideration decimal(18,2)").withColumn("date2", F.lit(1))
    runs = positions.runs(rows, calendar, **RULES).cache()
    assert runs.count() == len(days)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    saved = {k: spark.conf.get(k, None) for k in positions.STORE}
    for k, v in positions.STORE.items():
        spark.conf.set(k, v)
    try:
        # the second delivery repeats days of the first: those were decided and change nothing
        for low, high in [(0, 20), (10, len(days))]:
            runs.where(F.col("ordinal").between(low, high)).write.mode("append").parquet(folder)
            events = streams.run_available(positions.book_events(positions.read_runs(spark, folder), **RULES), spark, out, state)
        held = positions.held_now(spark, state).where("open").collect()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = positions.positions(events)
    wanted, told = plain_walk(filings, days, RULES["most_open"], RULES["days"], RULES["stale"], RULES["hold"])
    key = lambda r: tuple(r["key"].split("|"))
    assert sorted((key(r), r["filed"], r["entry_date"], r["exit_date"] or date.max) for r in found.collect()) == wanted
    assert sorted((key(r), r["entry_date"]) for r in held) == sorted((k, e) for k, _, e, x in wanted if x == date.max)
    answers = {}
    for r in positions.told(rows, calendar, found, RULES["days"], RULES["stale"]).collect():
        k = (r["date"], r["filed"], (r["ticker"], r["director"].strip().lower()), r["action"])
        answers[k] = answers.get(k, 0) + r["n"]
    assert answers == told
    assert len(wanted) >= 15 and {k[3] for k in told} == {"ENTER", "SKIP_DUPLICATE", "SKIP_ALREADY_OPEN", "SKIP_CAP"}


def test_books_and_empty_days(spark, tmp_path):
    calendar = spark.createDataFrame([(START, 0)], "date date, ordinal long")
    none = spark.createDataFrame([], "ticker string, director string, filed date, consideration decimal(18,2)")
    assert [r["rows"] for r in positions.runs(none, calendar).collect()] == [[]]
    book = positions.Book(**RULES)
    held, events = book.decide([], 0, START, [])
    assert (held, events) == ([], [])


def test_enough_keys_are_walked():
    """Blocked keys come first in the order, and the free ones after them still fill the slots."""
    assert positions.keys_to_walk(12, 30, 5, 63) == 36
    assert positions.keys_to_walk(2, 4, 2, 3) == 2 * (2 + 2)
