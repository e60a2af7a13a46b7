"""Operators against numpy and plain Python: synthetic truth, boundary values and stateful rules."""

import hashlib
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions import scalar, udfs
from tidemark.operators import asof, dedupe, evaluate, matching, portfolio, resample, returns, signals, stats, study


def weekdays(n, start=date(2022, 1, 3)):
    days, d = [], start
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += timedelta(1)
    return days


@pytest.fixture(scope="module")
def market(spark):
    """Two tickers on a market, as bars; ticker AAA lacks one day."""
    rng, days = np.random.default_rng(42), weekdays(400)
    m = rng.normal(0.0003, 0.01, 400)
    stocks = {"AAA": 0.0001 + 1.2 * m + rng.normal(0, 0.005, 400), "BBB": 0.7 * m + rng.normal(0, 0.01, 400)}
    rows = [("INDEX", d, float(100 * math.exp(x))) for d, x in zip(days, np.cumsum(m), strict=True)]
    for t, r in stocks.items():
        rows += [(t, d, float(50 * math.exp(x))) for i, (d, x) in enumerate(zip(days, np.cumsum(r), strict=True)) if (t, i) != ("AAA", 30)]
    return days, m, stocks, spark.createDataFrame(rows, "ticker string, date date, adj_close double")


def test_returns_do_not_span_gaps(market):
    days, m, stocks, bars = market
    found = {(r["ticker"], r["date"]): r["ret"] for r in returns.calendar_returns(bars).collect()}
    assert ("AAA", days[30]) not in found and ("AAA", days[31]) not in found and ("AAA", days[0]) not in found
    assert len(found) == 3 * 399 - 2
    assert all(abs(found["BBB", days[i]] - stocks["BBB"][i]) < 1e-9 for i in range(1, 400))


def test_study_against_numpy(spark, market):
    days, m, stocks, bars = market
    rets = returns.calendar_returns(bars)
    panel = returns.aligned(rets, "INDEX")
    index = rets.where("ticker = 'INDEX'").select("date")
    events = [("AAA", 200), ("AAA", 260), ("BBB", 200), ("BBB", 200), ("BBB", 300), ("BBB", 3), ("BBB", 395), ("CCC", 200)]
    ann = spark.createDataFrame([(i, t, datetime.combine(days[k], datetime.min.time()) + timedelta(hours=1)) for i, (t, k) in enumerate(events)], "ann_id int, ticker string, announced_at timestamp_ntz")
    dated = study.day_zero(ann, index)
    assert {r["ann_id"]: r["day0"] for r in dated.collect()} == {i: days[k] for i, (_, k) in enumerate(events)}
    studied = study.events(dated, panel)
    assert {r["status"]: r["n"] for r in study.report(studied).collect()} == {"studied": 5, "window": 2, "no_prices": 1}
    rows = study.study(ann, panel, index)
    aligned = {t: [(days[i], stocks[t][i], m[i]) for i in range(1, 400) if (t, i) not in (("AAA", 30), ("AAA", 31))] for t in stocks}
    ars, scars, ranks = [], [], []
    for t, k in events[:5]:
        at = [d for d, _, _ in aligned[t]].index(days[k])
        est, ev = (np.array([x[1:] for x in aligned[t][at + a : at + b + 1]]) for a, b in (study.ESTIMATION, study.EVENT))
        beta = np.cov(est[:, 0], est[:, 1])[0, 1] / np.var(est[:, 1], ddof=1)
        alpha = est[:, 0].mean() - beta * est[:, 1].mean()
        residual = est[:, 0] - alpha - beta * est[:, 1]
        sd = math.sqrt((residual**2).sum() / 98)
        ar = ev[:, 0] - alpha - beta * ev[:, 1]
        factor = np.sqrt(1 + 1 / 100 + (ev[:, 1] - est[:, 1].mean()) ** 2 / ((est[:, 1] - est[:, 1].mean()) ** 2).sum())
        ars.append(ar)
        scars.append((ar / (sd * factor)).sum() / math.sqrt(26))
        both = np.concatenate([residual, ar])
        order = np.empty(126)
        order[both.argsort()] = np.arange(1, 127)
        ranks.append(order[-26:] - 63.5)
    mean = np.mean(ars, axis=0)
    found = study.caar(rows).orderBy("rel_day").collect()
    assert np.allclose([r["mean_ar"] for r in found], mean, atol=1e-9) and np.allclose([r["caar"] for r in found], np.cumsum(mean), atol=1e-9) and {r["n"] for r in found} == {5}
    bmp = study.bmp(rows).first()
    assert bmp["z"] == pytest.approx(np.mean(scars) / (np.std(scars, ddof=1) / math.sqrt(5)))
    z = [r["z"] for r in study.corrado(rows).orderBy("rel_day").collect()]
    assert np.allclose(z, np.mean(ranks, axis=0) / math.sqrt((126**2 - 1) / 12 / 5))


def test_perfect_fit_has_no_residual(spark):
    rng = np.random.default_rng(1)
    rows = [("T", date(2024, 1, 1), 1, int(k), float(0.001 + 1.5 * x), float(x)) for k, x in zip(range(-120, -20), rng.normal(0, 0.01, 100), strict=True)]
    days = spark.createDataFrame(rows, "ticker string, day0 date, weight long, rel_day int, stock double, market double")
    model = study.market_model(days).first()
    assert model["residual_std"] < 1e-12 and model["beta"] == pytest.approx(1.5)
    flat = study.market_model(days.withColumn("market", F.lit(0.01))).first()
    assert flat["beta"] is None


def test_injected_jump_is_found(spark):
    rng = np.random.default_rng(42)
    rows = []
    for e in range(40):
        m = rng.normal(0.0003, 0.01, 126)
        s = 0.0001 + 1.1 * m + rng.normal(0, 0.01, 126)
        s[105] += 0.05
        rows += [("T", date(2024, 1, 1) + timedelta(e), 1, k, float(a), float(b)) for k, a, b in zip([*range(-120, -20), *range(-5, 21)], s, m, strict=True)]
    days = spark.createDataFrame(rows, "ticker string, day0 date, weight long, rel_day int, stock double, market double")
    ab = study.abnormal(days)
    assert study.bmp(ab).first()["z"] > 2
    z = {r["rel_day"]: r["z"] for r in study.corrado(ab).collect()}
    assert z[0] > 4 and abs(z[10]) < 4


@pytest.mark.parametrize(("hour", "minute", "expected"), [(5, 59, date(2026, 6, 5)), (6, 0, date(2026, 6, 8)), (0, 0, date(2026, 6, 5))])
def test_day_zero_rolls_after_the_close(spark, hour, minute, expected):
    calendar = spark.createDataFrame([(date(2026, 6, d),) for d in (1, 2, 3, 4, 5, 8, 9)], "date date")
    ann = spark.createDataFrame([("T", datetime(2026, 6, 5, hour, minute)), ("T", datetime(2026, 6, 20))], "ticker string, announced_at timestamp_ntz")
    found = [r["day0"] for r in study.day_zero(ann, calendar).orderBy("announced_at").collect()]
    assert found == [expected, None]


def test_anchor_greedy_against_a_walk(spark):
    rng = random.Random(1)
    rows = [(k, date(2024, 1, 1) + timedelta(rng.randint(0, 400))) for k in range(5) for _ in range(40)]
    found = {(r["k"], r["d"]) for r in dedupe.anchor_greedy(spark.createDataFrame([*rows, (9, None)], "k int, d date"), ["k"], "d", 30).collect()}
    wanted = set()
    for k in range(5):
        last = None
        for d in sorted(d for kk, d in rows if kk == k):
            if last is None or (d - last).days > 30:
                wanted.add((k, d))
                last = d
    assert found == wanted


def test_latest_and_pending(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 3, "w")], "k string, at int, v string")
    wanted = {("a", "y"), ("b", "z")}
    assert {(r["k"], r["v"]) for r in dedupe.latest(rows, ["k"], [F.desc("at"), F.desc("v")]).collect()} == wanted
    assert {(r["k"], r["v"]) for r in dedupe.latest_by_aggregate(rows, ["k"], F.struct("at", "v")).collect()} == wanted
    assert [r["k"] for r in dedupe.pending(rows.select("k").distinct(), rows.where("k = 'a'"), "k", limit=5).collect()] == ["b"]


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 5, 9)] + [("b", date(2024, 1, 5)), ("a", None)], "k string, d date")
    right = spark.createDataFrame([("a", date(2024, 1, 5)), ("a", date(2024, 1, 7))], "k string, r date")
    back = {(x["k"], x["d"]): x["asof_date"] for x in asof.asof(left, right, ["k"], "d", "r").collect()}
    assert back == {("a", date(2024, 1, 1)): None, ("a", date(2024, 1, 5)): date(2024, 1, 5), ("a", date(2024, 1, 9)): date(2024, 1, 7), ("b", date(2024, 1, 5)): None, ("a", None): None}
    ahead = {(x["k"], x["d"]): x["asof_date"] for x in asof.asof(left, right, ["k"], "d", "r", forward=True).collect()}
    assert ahead == {("a", date(2024, 1, 1)): date(2024, 1, 5), ("a", date(2024, 1, 5)): date(2024, 1, 5), ("a", date(2024, 1, 9)): None, ("b", date(2024, 1, 5)): None, ("a", None): None}


def walk(filings, results, opened, recent, today, least, stale, clean, days, most):
    """The rules one filing at a time, with state."""
    key = lambda t, p: (t.upper(), (p or "").strip().lower())
    open_keys, last, slots, made = {key(t, p) for t, p in opened}, {key(t, p): d for t, p, d in recent}, most - len(opened), []
    for t, p, filed, size in sorted(filings, key=lambda f: (f[2], f[0].upper(), f[1], f[3] or 0)):
        k, before = key(t, p), [d for tt, d in results if tt.upper() == t.upper() and d <= filed]
        gap = (filed - max(before)).days if before else None
        if size is None or size < least:
            action = "SKIP_SIZE"
        elif (today - filed).days > stale:
            action = "SKIP_STALE"
        elif gap is None:
            action = "SKIP_NO_RESULTS"
        elif gap <= clean:
            action = "SKIP_NOT_CLEAN"
        elif k in last and (filed - last[k]).days <= days:
            action = "SKIP_DUPLICATE"
        elif k in open_keys:
            action = "SKIP_ALREADY_OPEN"
        elif slots <= 0:
            action = "SKIP_CAP"
        else:
            action, last[k], slots = "ENTER", filed, slots - 1
            open_keys.add(k)
        made.append((t.upper(), p, filed, size, action))
    return made


@pytest.mark.parametrize("seed", range(4))
def test_entries_against_a_walk(spark, seed):
    rng, today = random.Random(seed), date(2026, 7, 14)
    day = lambda back: today - timedelta(rng.randint(0, back))
    filings = [(rng.choice(["aaa", "AAA", "BBB", "CCC", "DDD"]), rng.choice(["Ann ", "ann", "Bob", "Cy"]), day(90), rng.choice([None, 999_999, 1_000_000, 5_000_000, 7_000_000])) for _ in range(70)]
    results = [("AAA", today - timedelta(120)), ("BBB", today - timedelta(100)), ("CCC", day(80))]
    opened, recent = [("BBB", "bob")], [("AAA", "Cy", today - timedelta(70))]
    gated = signals.gated(
        spark.createDataFrame(filings, "ticker string, director string, filed date, consideration int"), spark.createDataFrame(results, "ticker string, d date"), F.lit(today), stale=80
    )
    found = signals.select_entries(gated, spark.createDataFrame(opened, "ticker string, director string"), spark.createDataFrame(recent, "ticker string, director string, last_filed date"), most_open=4)
    wanted = walk(filings, results, opened, recent, today, 1_000_000, 80, 30, 30, 4)
    assert sorted(map(str, [(r["ticker"], r["director"], r["filed"], r["consideration"], r["action"]) for r in found.collect()])) == sorted(map(str, wanted))


@pytest.mark.parametrize(("back", "size", "gap", "reason"), [(0, 999_999, 60, "SIZE"), (0, 1_000_000, 60, None), (5, 1_000_000, 60, None), (6, 1_000_000, 60, "STALE"), (0, 1_000_000, 30, "NOT_CLEAN"), (0, 1_000_000, 31, None), (0, 1_000_000, None, "NO_RESULTS")])
def test_gate_boundaries(spark, back, size, gap, reason):
    today = date(2026, 7, 14)
    filed = today - timedelta(back)
    results = [("T", filed - timedelta(gap))] if gap is not None else []
    gated = signals.gated(spark.createDataFrame([("T", "x", filed, size)], "ticker string, director string, filed date, consideration int"), spark.createDataFrame(results, "ticker string, d date"), F.lit(today))
    assert gated.first()["reason"] == reason


@pytest.mark.parametrize(("passed", "due"), [(62, 0), (63, 1)])
def test_exits(spark, passed, due):
    days = weekdays(80)
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, ordinal int")
    entry = days[4] + timedelta(1) if days[4].weekday() == 4 else days[5]  # a Saturday counts from Monday
    position = spark.createDataFrame([("T", "x", entry)], "ticker string, director string, entry_date date")
    first = next(i for i, d in enumerate(days) if d >= entry)
    assert signals.exits_due(position, calendar, days[first + passed]).count() == due
    assert signals.exits_due(position, calendar, days[-1] + timedelta(9)).count() == 0


def test_greedy_matching_against_a_walk(spark):
    fields = (evaluate.Field("n", text=True, identity=True, strong=True), evaluate.Field("t", text=True, identity=True), evaluate.Field("d", identity=True, strong=True), evaluate.Field("q"))
    rng = random.Random(3)
    item = lambda: (rng.choice(["Ann", "Bob ", None]), rng.choice(["buy", "SELL"]), rng.choice([date(2024, 1, 1), date(2024, 1, 2), None]), rng.choice([1, 2, None]))
    gold = {k: [item() for _ in range(rng.randint(0, 4))] for k in range(120)}
    pred = {k: [(str(a).lower() if a else a, str(b).upper(), c, d) for a, b, c, d in (item() for _ in range(rng.randint(0, 4)))] for k in range(120)}
    schema = "k int, idx int, n string, t string, d date, q int"
    frames = [spark.createDataFrame([(k, i, *x) for k, xs in side.items() for i, x in enumerate(xs)], schema) for side in (gold, pred)]
    norm = lambda x: " ".join(x.split()).lower() if isinstance(x, str) else x
    wanted = set()
    for k in gold:
        pairs = []
        for g, a in enumerate(gold[k]):
            for p, b in enumerate(pred[k]):
                same = [norm(x) == norm(y) for x, y in zip(a, b, strict=True)]
                ident = [s and x is not None for s, x in zip(same, a, strict=True)]
                if sum(ident[:3]) >= 2 and (ident[0] or ident[2]):
                    pairs.append((-sum(same), -sum(ident[:3]), g, p))
        ug, up = set(), set()
        for _, _, g, p in sorted(pairs):
            if g not in ug and p not in up:
                ug.add(g), up.add(p), wanted.add((k, g, p))
    assert {(r["k"], r["g"], r["p"]) for r in evaluate.match(*frames, "k", fields).collect()} == wanted


def test_counts_of_lists(spark):
    """What ``score_lists`` gives, counted, with equal items, unmatched ones and documents of one side; rows are made after the shuffles."""
    fields = (evaluate.Field("n", text=True, identity=True, strong=True), evaluate.Field("d", identity=True, strong=True), evaluate.Field("q"))
    rng = random.Random(8)
    item = lambda: (rng.choice(["Ann", "Bob ", None]), rng.choice([date(2024, 1, 1), date(2024, 1, 2)]), rng.choice([1, 2, None]))
    golden, stated = (spark.createDataFrame([(k, i, *item()) for k in range(50) if k % m for i in range(rng.randint(1, 5))], "k int, idx int, n string, d date, q int") for m in (7, 9))
    wanted = evaluate.score_lists(golden, stated, "k", fields).groupBy("k", "field", "outcome").agg(F.count("*").alias("n"))
    found = evaluate.count_lists(golden, stated, "k", fields)
    rows = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert found.columns == wanted.columns and rows(found) == rows(wanted)
    assert {r["outcome"] for r in found.collect()} == {*evaluate.OUTCOMES}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_totals_of_lists_without_a_sum_by_document(spark, monkeypatch):
    """What ``count_lists`` gives, summed over documents, also where documents are taken for long ones; nothing is written but classes
    and edges, and lists in one frame that is dealt by document are not dealt again."""
    fields = (evaluate.Field("n", text=True, identity=True, strong=True), evaluate.Field("d", identity=True, strong=True), evaluate.Field("q"))
    rng = random.Random(21)
    item = lambda: (rng.choice(["Ann", " ann", "Bob", "Cy", None]), rng.choice([date(2024, 1, 1), date(2024, 1, 2), None]), rng.choice([1, 2, 3, None]))
    golden, stated = (spark.createDataFrame([(k, i, *item()) for k in range(60) if k % m for i in range(rng.randint(1, 6))], "k int, idx int, n string, d date, q int") for m in (7, 9))
    wanted = sorted(tuple(r) for r in evaluate.count_lists(golden, stated, "k", fields).groupBy("field", "outcome").agg(F.sum("n")).collect())
    names, written = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: (names.append(name), written(df, name))[1])
    both = matching.sides(golden, stated)
    for few in (matching.FEW_CLASSES, 1):
        monkeypatch.setattr(matching, "FEW_CLASSES", few)
        assert sorted(tuple(r) for r in evaluate.total_lists(both, None, "k", fields).collect()) == wanted
    assert "matched" not in names and "golden" not in names
    dealt = evaluate.listed(both.repartition(3, "k"), None, "k", fields)
    plan = matching.classes(dealt, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_dominant_edges_against_a_walk(spark):
    """Rounds of locally dominant edges take what a walk from the best edge on takes, ties and all."""
    rng = random.Random(5)
    edges = {(k, rng.randrange(12), rng.randrange(12)): rng.randrange(4) for k in range(60) for _ in range(rng.randint(0, 60))}
    frame = spark.createDataFrame([(*e, w) for e, w in edges.items()], "k int, g int, p int, w int")
    wanted, used = set(), set()
    for w, k, g, p in sorted((w, k, g, p) for (k, g, p), w in edges.items()):
        if ("g", k, g) not in used and ("p", k, p) not in used:
            used |= {("g", k, g), ("p", k, p)}
            wanted.add((k, g, p))
    found = matching.dominant(frame, ["k", "g"], ["k", "p"], ["w"]).collect()
    assert len(found) == len(wanted) and {(r["k"], r["g"], r["p"]) for r in found} == wanted
    assert matching.dominant(frame.limit(0), ["k", "g"], ["k", "p"], ["w"]).count() == 0


def test_a_document_of_many_items(spark):
    """100,000 items a side in one document, a third of them equal; every item finds its own."""
    fields = (evaluate.Field("n", text=True, identity=True, strong=True), evaluate.Field("t", text=True, identity=True), evaluate.Field("d", identity=True, strong=True), evaluate.Field("q"))
    n = 100_000
    base = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("idx"), F.col("id").alias("__id"))
    equal = F.col("__id") % 3 == 0
    golden = base.select("k", "idx", F.when(equal, "same").otherwise(F.concat(F.lit("n"), "__id")).alias("n"), F.lit("buy").alias("t"), F.lit(date(2024, 1, 1)).alias("d").cast("date"), F.when(equal, 1).otherwise(F.col("__id")).cast("long").alias("q"))
    golden = golden.withColumn("d", F.when(F.col("n") == "same", F.col("d")).otherwise(F.date_add("d", (F.col("idx") / 4).cast("int"))))
    stated = golden.withColumn("q", F.when(F.col("idx") % 5 == 1, F.col("q") + 1).otherwise(F.col("q"))).withColumn("n", F.upper("n")).withColumn("n", F.when((F.col("idx") % 7 == 2) & (F.col("n") != "SAME"), F.lit(None)).otherwise(F.col("n")))
    pairs = evaluate.match(golden, stated, "k", fields)
    assert pairs.agg(F.count("*"), F.count_distinct("g"), F.count_distinct("p")).first() == (n, n, n)
    unlike = evaluate.score_lists(golden, stated, "k", fields).where("field <> 'q' and outcome not in ('correct', 'missed')").count()
    assert unlike == 0


def test_outcomes_and_empty_tally(spark):
    rows = spark.createDataFrame([(None, None), (None, "x"), ("x", None), (" A  b", "a B "), ("a", "b")], "g string, p string")
    assert [r[0] for r in rows.select(scalar.outcome(F.col("g"), F.col("p"), text=True)).collect()] == ["correct", "hallucinated", "missed", "correct", "wrong"]
    tally = evaluate.tally(spark.createDataFrame([], "field string, outcome string"), ["b", "a"])
    assert [(r["field"], r["total"], r["accuracy"]) for r in tally.orderBy("position").collect()] == [("b", 0, None), ("a", 0, None)]
    assert evaluate.evaluation_run(tally).first()["overall_accuracy"] is None


def test_p_values(spark):
    found = spark.createDataFrame([(0.0,), (1.96,), (-1.96,), (None,)], "z double").select(udfs.z_to_p("z")).collect()
    assert found[0][0] == 1 and found[1][0] == found[2][0] == pytest.approx(0.04999579) and found[3][0] is None


def test_nearest_match_ties_and_gaps(spark):
    treated = spark.createDataFrame([(1, 5.0), (1, 100.0), (2, 1.0), (3, 1.0)], "g int, v double")
    pool = spark.createDataFrame([(1, 4.0, "b"), (1, 6.0, "a"), (1, 6.0, "c"), (2, 9.0, "z")], "g int, v double, k string")
    found = {(r["g"], r["v"]): r["match"] for r in resample.nearest_match(treated, pool, ["g"], "v", "k").collect()}
    assert found == {(1, 5.0): "a", (1, 100.0): "a", (2, 1.0): "z"}


def test_resampling_repeats(spark):
    rows = spark.range(500).withColumn("v", F.col("id") % 7)
    a, b = (resample.poisson_bootstrap(rows, "v", F.col("id"), 50).orderBy("draw").collect() for _ in range(2))
    assert a == b and np.std([r["mean"] for r in a]) == pytest.approx(2 / math.sqrt(500), rel=0.35)
    assert np.mean([r["mean"] for r in a]) == pytest.approx(rows.agg(F.avg("v")).first()[0], abs=0.05)


def test_disjoint_windows_against_all_sets(spark):
    """As many windows as any set without two that share a day, chosen by earliest end."""
    import itertools

    rng = random.Random(2)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    groups = {k: [(a := rng.randrange(20), a + rng.randrange(6)) for _ in range(rng.randint(1, 8))] for k in range(25)}
    rows = [(k, i, day(a), day(b)) for k, xs in groups.items() for i, (a, b) in enumerate(xs)] + [(99, 0, None, day(1)), (99, 1, day(1), None), (98, 0, day(3), day(2))]
    found = {}
    for r in resample.disjoint(spark.createDataFrame(rows, "k int, i int, s date, e date"), ["k"], "s", "e").collect():
        found.setdefault(r["k"], []).append((r["s"], r["e"]))
    apart = lambda xs: all(x[1] < y[0] for x, y in itertools.pairwise(sorted(xs)))
    assert set(found) == set(groups)
    for k, xs in groups.items():
        most = max(len(c) for n in range(len(xs) + 1) for c in itertools.combinations(xs, n) if apart(c))
        assert len(found[k]) == most and apart(found[k])


def test_windows_clear_of_events(spark):
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    windows = spark.createDataFrame([("a", day(n)) for n in (0, 91, 92, 183, 300)] + [("b", day(0))], "t string, d date")
    events = spark.createDataFrame([("a", day(183)), ("a", day(209))], "t string, x date")
    assert sorted((r["t"], r["d"]) for r in resample.clear_of_events(windows, events, ["t"], "d", "x").collect()) == [("a", day(0)), ("a", day(91)), ("b", day(0))]


def test_interval_of_draws(spark):
    draws = spark.createDataFrame([(i, float(i)) for i in range(1, 201)], "draw int, mean double")
    assert tuple(resample.interval(draws, 50.0).first()) == (200, 5.0, 195.0, 0.25)
    assert tuple(resample.interval(draws.limit(0), 1.0).first()) == (0, None, None, None)


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200)
    rows = spark.createDataFrame([(float(c), float(a), float(b)) for (a, b), c in zip(x, y, strict=True)], "y double, a double, b double")
    full = np.column_stack([np.ones(200), x])
    beta, rss, _, _ = np.linalg.lstsq(full, y, rcond=None)
    t = beta / np.sqrt(rss[0] / 197 * np.diag(np.linalg.inv(full.T @ full)))
    found = stats.ols(rows, "y", ["a", "b"]).collect()
    assert np.allclose([r["coefficient"] for r in found], beta) and np.allclose([r["t"] for r in found], t)


def test_portfolio_costs_and_drawdown(spark):
    panel = spark.createDataFrame([("T", date(2024, 1, 1) + timedelta(i), 0.01, 0.0, i) for i in range(6)], "ticker string, date date, stock double, market double, idx int")
    days = portfolio.daily(spark.createDataFrame([("T", 0), ("T", 1)], "ticker string, pos int"), panel, hold=2).orderBy("date").collect()
    assert [round(r["ret"], 6) for r in days] == [0.008, 0.008, 0.008] and [r["n_open"] for r in days] == [1, 2, 1]
    fall = spark.createDataFrame([(date(2024, 1, i + 1), r) for i, r in enumerate([0.1, -0.2, 0.05, 0.2])], "date date, ret double")
    assert [round(r["drawdown"], 6) for r in portfolio.drawdown(fall).orderBy("date").collect()] == [0.0, -0.2, -0.15, 0.0]


@pytest.mark.parametrize(("parts", "aqe", "advisory"), [(50, "true", "64m"), (50, "false", "64m"), (200, "true", "500k"), (7, "true", "10k"), (1, "true", "64m")])
def test_ranks_over_many_ranges(spark, parts, aqe, advisory):
    """Nearly all scores differ; the ranges must be the same wherever the plan asks for them."""
    import numpy as np

    n = 200_000
    rows = spark.range(n, numPartitions=9).select((F.xxhash64("id") % 1_000_000 / 7).alias("score"), (F.xxhash64("id", F.lit(1)) % 5 == 0).alias("y"))
    rows = rows.withColumn("score", F.col("score") + F.when(F.col("y"), 40_000).otherwise(0))
    values = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": aqe, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory}
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        found = stats.auc(rows, "score", F.col("y")).first()
        cuts = stats.percentiles(rows, "score", [0.0, 0.013, 0.5, 1.0])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    data = rows.toPandas()
    score, y = data["score"].to_numpy(), data["y"].to_numpy()
    _, place, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[place]
    pos = int(y.sum())
    assert (found["n"], found["pos"]) == (n, pos)
    assert found["auc"] == pytest.approx((ranks[y].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)), abs=1e-12)
    assert cuts == pytest.approx(np.quantile(score, [0.0, 0.013, 0.5, 1.0]).tolist())


def test_percentiles_of_odd_tables(spark):
    rows = spark.createDataFrame([(None,), (2.0,), (2.0,), (5.0,)], "v double")
    assert stats.percentiles(rows, "v", [0.0, 0.5, 0.75, 1.0]) == [2.0, 2.0, 3.5, 5.0]
    assert stats.percentiles(rows.where("v > 9"), "v", [0.5]) == [None]


def test_hazard_auc_against_dense_ranks(spark):
    from tidemark.operators import models

    rows = spark.range(4000).select((F.xxhash64("id") % 1000 / 100).alias("a"), (F.xxhash64("id", F.lit(2)) % 1000 / 100).alias("b"), (F.col("id") % 3 > 0).alias("train"))
    rows = rows.withColumn("label", (F.col("a") - F.col("b") + F.xxhash64("a", "b", F.lit(5)) % 7 > 0).cast("double"))
    scored = models.logistic_hazard(rows, "label", ["a", "b"], F.col("train")).toPandas()
    found = stats.auc(spark.createDataFrame(scored), "hazard", F.col("label") == 1).first()["auc"]
    high, low = scored.hazard[scored.label == 1].to_numpy(), scored.hazard[scored.label == 0].to_numpy()
    dense = ((high[:, None] > low).sum() + (high[:, None] == low).sum() / 2) / (len(high) * len(low))
    assert found == pytest.approx(dense) and 0.6 < found < 1


def test_logistic_terms_against_dense_newton(spark):
    from tidemark.operators import models

    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (3000, 2)) * [1, 50]
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.4 * x[:, 0] - 0.02 * x[:, 1])))).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), 7.0, float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 7.0, 1.0), (1.0, 1.0, 7.0, None)], "a double, b double, same double, y double")
    z = np.column_stack([np.ones(3000), (x - x.mean(0)) / x.std(0, ddof=1)])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        info = (z * (p * (1 - p))[:, None]).T @ z
        beta = beta + np.linalg.solve(info, z.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(info)))
    found = {r["term"]: r for r in models.logistic_terms(rows, "y", ["a", "b"]).collect()}
    for term, b, e in zip(["const", "a", "b"], beta, errors, strict=True):
        assert (found[term]["coefficient"], found[term]["se"], found[term]["z"]) == pytest.approx((b, e, b / e), rel=1e-5)
    constant = {r["term"]: r for r in models.logistic_terms(rows, "y", ["a", "same"]).collect()}
    assert constant["same"]["coefficient"] == 0 and constant["same"]["z"] is None and constant["a"]["z"] > 5
    # labels that a term separates: finite, and the order of hazards is right
    apart = spark.createDataFrame([(float(i), float(i > 50), i % 2 == 0) for i in range(100)], "a double, y double, train boolean")
    hazards = [r["hazard"] for r in models.logistic_hazard(apart, "y", ["a"], F.col("train")).orderBy("a").collect()]
    assert all(map(math.isfinite, hazards)) and hazards[0] < 1e-6 and hazards[-1] > 1 - 1e-6


def test_trailing_features_on_daily_bars(spark):
    rng = np.random.default_rng(9)
    stock, market = rng.normal(0, 0.02, 300), rng.normal(0, 0.01, 300)
    rows = [("AAA", date(2024, 1, 1) + timedelta(i), i, float(s), float(m)) for i, (s, m) in enumerate(zip(stock, market, strict=True))]
    found = returns.trailing_features(spark.createDataFrame(rows, "ticker string, date date, idx int, stock double, market double")).orderBy("idx").collect()
    level, i = np.cumsum(stock), 280
    wanted = ((stock - market)[i - 126 : i].sum(), stock[i - 62 : i + 1].std(ddof=1), level[i] - level[i - 251 : i + 1].max(), np.abs(stock[i - 63 : i]).mean())
    assert tuple(found[i][c] for c in ("momentum", "volatility", "from_high", "mean_abs")) == pytest.approx(wanted)
    assert found[0]["momentum"] is None and found[0]["from_high"] == 0


def test_distances_to_marks(spark):
    day = lambda n: date(2024, 1, n)
    rows = spark.createDataFrame([("A", day(5)), ("A", day(10)), ("A", day(20)), ("B", day(5)), ("A", None)], "t string, d date")
    marks = spark.createDataFrame([("A", day(5)), ("A", day(12)), ("C", day(1))], "t string, m date")
    found = {(r["t"], r["d"]): (r["since"], r["until"]) for r in asof.distances(rows, marks, ["t"], "d", "m").collect()}
    assert found == {("A", day(5)): (0, 7), ("A", day(10)): (5, 2), ("A", day(20)): (8, None), ("B", day(5)): (None, None), ("A", None): (None, None)}


def test_person_periods_against_plain(spark):
    from tidemark.operators import models

    rng, start = random.Random(3), date(2024, 1, 1)
    snaps = [(rng.choice("ABC"), start + timedelta(rng.randrange(100)), i) for i in range(120)] + [(None, start, 998), ("A", None, 999)]
    events = [(rng.choice("AB"), start + timedelta(rng.randrange(100))) for _ in range(15)] * 2
    until = start + timedelta(100)
    found = models.person_periods(spark.createDataFrame(snaps, "k string, d date, id int"), spark.createDataFrame(events, "k string, d date"), ["k"], "d", 10, until)
    wanted = {}
    for k, d, i in snaps:
        if k and d and d + timedelta(10) <= until:
            own = {e for t, e in events if t == k}
            wanted[i] = (sum(e <= d for e in own), float(any(d < e <= d + timedelta(10) for e in own)))
    assert {r["id"]: (r["past"], r["label"]) for r in found.collect()} == wanted


def bits(digits, *seed):
    """The generator's bits, by the standard library."""
    return int(hashlib.md5(":".join(map(str, seed)).encode()).hexdigest()[:digits], 16)


def test_permutations_keep_the_sizes_of_the_groups(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 7 == 0).alias("l")).withColumn("v", F.when(F.col("id") % 50 != 3, F.col("v")))
    found = {r["draw"]: r["difference"] for r in resample.permutation(rows, "v", F.col("l"), F.col("id"), draws=20, seed=4).collect()}
    hashed = rows.where("v is not null").crossJoin(spark.range(1, 21).select(F.col("id").cast("int").alias("draw"))).toPandas()
    hashed["h"] = [bits(15, 4, d, i) for d, i in zip(hashed.draw, hashed.id, strict=True)]
    k = int(rows.where("v is not null and l").count())
    for draw, part in hashed.groupby("draw"):
        part = part.sort_values(["h", "id"])
        assert found[draw] == pytest.approx(part.v[:k].mean() - part.v[k:].mean())
    assert len(found) == 20 and len(set(found.values())) == 20
    none = resample.permutation(rows, "v", F.lit(False), F.col("id"), draws=2).collect()
    assert [r["difference"] for r in none] == [None, None]


def test_placebo_counts_before_it_shuffles(spark, tmp_path):
    """What is drawn meets values as counts, not row by row, and events of one file are drawn in many tasks."""
    spark.range(20_000).selectExpr("'t' as ticker", "id as event_id").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    values = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 4.0), ("t", 2, None)], "ticker string, i int, value double")
    found = resample.placebo(events, values, draws=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    kinds = [line.lstrip(" :+-").split(" ")[0] for line in plan]
    assert kinds.index("Join") < kinds.index("Aggregate", kinds.index("Join")) < kinds.index("Generate") < kinds.index("RepartitionByExpression")
    for r in found.collect():
        picks = [bits(8, 1, r["draw"], e) * 3 >> 32 for e in range(20_000)]
        assert r["mean"] == pytest.approx((picks.count(0) + 4 * picks.count(1)) / (20_000 - picks.count(2)))
    none = values.withColumn("value", F.lit(None).cast("double"))
    assert [r["mean"] for r in resample.placebo(events, none, draws=2).collect()] == [None, None]


def test_spearman_is_dealt_once_in_proportion_to_rows(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id % 7 as g", "(id * 37) % 101 as a", "(id * 53) % 13 as b")
    before = sorted((r["g"], r["n"], round(r["rho"], 9)) for r in stats.spearman(rows, "a", "b", ["g"]).collect())
    monkeypatch.setattr(stats, "RANKED", 100)
    found = stats.spearman(rows, "a", "b", ["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(g#" in plan and ", 40)" in plan
    assert sorted((r["g"], r["n"], round(r["rho"], 9)) for r in found.collect()) == before
    scipy_like = rows.where("g = 3").toPandas()
    assert before[3][2] == pytest.approx(scipy_like.a.rank().corr(scipy_like.b.rank()), abs=1e-8)


def test_placebo_and_bootstrap_against_their_picks(spark):
    values = spark.range(60).select((F.col("id") % 2).cast("string").alias("ticker"), (F.col("id") / 2).cast("int").alias("i"), F.sqrt("id").alias("value"))
    events = spark.createDataFrame([("0", 5), ("1", 6), ("1", 7), ("none", 8)], "ticker string, event_id long")
    found = {r["draw"]: r["mean"] for r in resample.placebo(events, values, draws=9, seed=3).collect()}
    by = {(r["ticker"], r["i"]): r["value"] for r in values.collect()}
    picks = [{"draw": n} | {str(e): bits(8, 3, n, e) * 30 >> 32 for e in (5, 6, 7)} for n in range(1, 10)]
    for r in picks:
        assert found[r["draw"]] == pytest.approx((by["0", r["5"]] + by["1", r["6"]] + by["1", r["7"]]) / 3)
    rows = values.withColumn("id", F.concat_ws("#", "ticker", "i"))
    means = {r["draw"]: r["mean"] for r in resample.poisson_bootstrap(rows, "value", F.col("id"), 30).collect()}
    u = rows.crossJoin(spark.range(1, 31).select(F.col("id").cast("int").alias("draw"))).toPandas()
    u["u"] = [bits(8, 1, d, i) / 2.0**32 for d, i in zip(u.draw, u.id, strict=True)]
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(6)])
    u["w"] = [int((x >= edges).sum()) for x in u.u]
    for draw, part in u.groupby("draw"):
        assert means[draw] == pytest.approx((part.w * part.value).sum() / part.w.sum())


def test_page_facts_against_plain_patterns(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    found = {r["page_id"]: r["f"] for r in pages.select("page_id", udfs.page_facts("html").alias("f")).collect()}
    for page_id, source in pages.collect():
        bare = re.sub(r"(?is)<(script|style|title)\b.*?</\1>", "", re.sub(r"(?s)<!--.*?-->", "", source))
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", source)
        words = html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()
        f = found[page_id]
        assert f["title"] == (html.unescape(title[1]).strip() if title else "") and f["n_links"] == len(re.findall(r"(?i)<a\s[^>]*href", source)) and f["n_words"] == len(words)


def test_decile_lift_against_numpy(spark):
    from tidemark.operators import models

    rows = spark.range(5000).select((F.xxhash64("id") % 9973 / 3).alias("score"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("double").alias("label"))
    found = {r["decile"]: (r["n"], r["rate"], r["lift"]) for r in models.decile_lift(rows, "score", "label").collect()}
    data = rows.toPandas()
    cuts = np.quantile(data.score, [i / 10 for i in range(1, 10)])
    decile = 10 - (data.score.to_numpy()[:, None] > cuts).sum(axis=1)
    for d in range(1, 11):
        own = data.label[decile == d]
        assert found[d] == (len(own), pytest.approx(own.mean()), pytest.approx(own.mean() / data.label.mean()))


def test_percentiles_of_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 500 / 7).alias("v")).union(spark.createDataFrame([(9, None), (8, 1.5)], "g long, v double"))
    found = {r["g"]: (r["p0"], r["p1"]) for r in stats.percentiles_by(rows, "v", [0.333, 0.5], ["g"]).collect()}
    data = rows.toPandas().dropna()
    assert found == {g: pytest.approx(tuple(np.quantile(own.v, [0.333, 0.5]))) for g, own in data.groupby("g")}
