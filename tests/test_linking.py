"""Events across documents: classes against all pairs, chains, odd values, and rates of contested statements."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import linking

START = date(2024, 1, 1)
SCHEMA = "k string, d date, v double, doc int"


def all_pairs(rows, days, share):
    """The class of each whole row by joining all pairs."""
    whole = [r for r in rows if None not in r[:3]]
    at = list(range(len(whole)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(whole):
        for j, b in enumerate(whole[:i]):
            low, high = sorted((abs(a[2]), abs(b[2])))
            if a[0] == b[0] and abs((a[1] - b[1]).days) <= days and a[2] * b[2] >= 0 and (a[2] == 0) == (b[2] == 0) and high - low <= share * high:
                at[root(i)] = root(j)
    least = {}
    for i, r in enumerate(whole):
        least[root(i)] = min(least.get(root(i), r[1:3]), r[1:3])
    return sorted((r[3], *least[root(i)]) for i, r in enumerate(whole))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    values = [0.0, -5.0, -5.01, 1.0, 1.005, 1.012, 100.0, 100.9, 101.8, 1e9]
    rows = [(rng.choice("AAAB"), START + timedelta(rng.randrange(40)), rng.choice(values) * rng.choice([1, 1, 1.003]), i) for i in range(150)]
    rows += [(None, START, 1.0, 900), ("A", None, 1.0, 901), ("A", START, None, 902)] + [(*rows[0][:3], 800), (*rows[1][:3], 801)]
    found = linking.linked_events(spark.createDataFrame(rows, SCHEMA), ["k"], "d", "v", 3).collect()
    assert len(found) == len(rows)
    assert all(r["event_date"] is None and r["event_value"] is None for r in found if r["doc"] >= 900)
    assert sorted((r["doc"], r["event_date"], r["event_value"]) for r in found if r["doc"] < 900) == all_pairs(rows, 3, 0.01)


def test_long_chains_and_empty(spark):
    """A chain over 300 days by steps of two is one class; a gap of three cuts it."""
    rows = [("A", START + timedelta(2 * i + (i >= 150)), 10.0 * 1.0001**i, i) for i in range(300)]
    found = linking.linked_events(spark.createDataFrame(rows, SCHEMA), ["k"], "d", "v", 2).select("event_date").distinct().collect()
    assert sorted(r[0] for r in found) == [START, START + timedelta(301)]
    assert linking.linked_events(spark.createDataFrame([], SCHEMA), ["k"], "d", "v", 2).count() == 0
    with pytest.raises(ValueError):
        linking.links(spark.createDataFrame(rows, SCHEMA), ["k"], "d", "v", 2, share=0.5)


def test_contested_lift(spark):
    rows = [("e1", 100.0, 100.0), ("e1", 100.5, 100.0), ("e2", 50.0, 50.0), ("e2", 60.0, 50.0), ("e2", 50.0, 50.0), ("e3", 7.0, 8.0), ("e4", 1.0, 1.0), ("e4", 1.0, 1.0), ("e5", None, 1.0), ("e5", 1.0, 1.0)]
    found = {r["verdict"]: r for r in linking.contested_lift(spark.createDataFrame(rows, "e string, v double, truth double"), ["e"], "v", "truth").collect()}
    good, bad = found["corroborated"], found["contested"]
    assert (good["n"], good["errors"], good["elsewhere"], good["error_rate"], good["lift"]) == (4, 1, 1, 0.25, 1.0)
    assert (bad["n"], bad["errors"], bad["elsewhere"]) == (3, 1, 1) and bad["lift"] == pytest.approx(4 / 3)


def test_links_grow_with_rows_and_not_with_days(spark):
    """Of rows that are alike on many days each makes two links at most, and rows of one day and value none; stretches and
    ranges of values are crossed."""
    rng = random.Random(5)
    rows = [(rng.choice("AB"), START + timedelta(rng.randrange(400)), round(rng.choice([1, -1]) * rng.uniform(9, 9.6), 3), i) for i in range(1500)]
    rows += [("C", START, 7.0, 2000 + i) for i in range(50)]
    events = spark.createDataFrame(rows, SCHEMA)
    found = linking.links(events, ["k"], "d", "v", 10).count()
    assert 1000 < found <= 2000
    same = linking.linked_events(events, ["k"], "d", "v", 10).collect()
    assert sorted((r["doc"], r["event_date"], r["event_value"]) for r in same) == all_pairs(rows, 10, 0.01)
