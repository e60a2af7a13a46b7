"""The same event in several documents: links within days and within a share of the value, classes of what links chain
together, and how much oftener contested values are wrong than corroborated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

#: Width of a range of values, in logarithms; at least that of the tolerance.
RANGE = 0.25


def near(low: Column, high: Column, share: float) -> Column:
    """Whether two values, the first no larger in size, lie within a share of the larger."""
    return F.abs(high) - F.abs(low) <= share * F.abs(high)


#: Days of a stretch, in multiples of the days that a link may span; stretches overlap by one such span.
STRETCH = 32


def links(events: DataFrame, keys: list[str], date: str, value: str, days: int, share: float = 0.01) -> DataFrame:
    """a, b (structs of keys, date, value): pairs whose classes are those of all pairs of one key and sign, at most ``days``
    apart, with values within ``share`` of the larger.

    No pairs are formed, and a row makes two links at most. Rows are dealt by key, range of values and stretch of days, and read
    by ascending value. Days up to ``days`` before a row are close to one another, and so are those after it. What lies there
    within the share of the row is thus linked already, so the last one on each side stands for the others. Rows that reach
    the next range or are of the first ``days`` of a stretch are dealt to both.
    """
    if share >= RANGE:
        raise ValueError(f"share has to be below {RANGE}")
    node = F.struct(*keys, F.col(date).alias("date"), F.col(value).cast("double").alias("value"))
    nodes = events.dropna(subset=[*keys, date, value]).select(node.alias("node")).distinct()
    size, day, width = F.abs("node.value"), F.unix_date("node.date"), STRETCH * (days + 1)
    place = lambda x: F.coalesce(F.floor(F.ln(F.when(x > 0, x)) / RANGE), F.lit(-(2**40)))
    reach = place(size / (1 - share) * (1 + 1e-9))  # a little more than needed, as it is rounded
    sign = F.when(F.isnan("node.value"), 2).otherwise(F.signum("node.value").cast("int"))
    spread = nodes.select("node", size.alias("size"), sign.alias("sign"), day.alias("day"), F.explode(F.sequence(place(size), reach)).alias("range"))
    spread = spread.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("day") - days) / width), F.floor(F.col("day") / width))))
    names = [f"k{i}" for i in range(len(keys))]
    where = [*names, "sign", "range", "stretch"]
    dealt = spread.select(*[F.col(f"node.{k}").alias(n) for k, n in zip(keys, names, strict=True)], "sign", "range", "stretch", "size", "day", F.col("node.value").alias("value")).repartition(*where).sortWithinPartitions(*where, "size", "day")
    kinds = dict(dealt.dtypes)
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "day_a int, value_a double, day_b int, value_b double"])

    def sweep(batches):
        import numpy as np
        import pyarrow as pa

        group, first, at, last, known = None, 0, 0, [], []
        for batch in batches:
            rows, found, before, values = zip(*[batch.column(c).to_pylist() for c in where], strict=True), [], [], []
            stretches, days_of, sizes, stated = (batch.column(c).to_pylist() for c in ("stretch", "day", "size", "value"))
            for i, row in enumerate(rows):
                if row != group:
                    # for each day of the stretch the place and value of what was read last, with room on either side
                    group, first, at = row, stretches[i] * width - days, 0
                    last, known = [0] * (width + 3 * days + 1), {}
                at += 1
                d, own = days_of[i] - first, sizes[i]
                least, seen = share * own, None
                for low, high in ((d - days, d + 1), (d, d + days + 1)):
                    latest = max(last[low:high])
                    if latest:
                        near_day = last.index(latest, low, high)
                        other = known[near_day]
                        # what is close to the one before it on the other side is linked to that
                        if not own - abs(other) > least and (seen is None or near_day - seen > days):
                            found.append(i)
                            before.append(near_day + first)
                            values.append(other)
                            seen = near_day
                last[d], known[d] = at, stated[i]
            take = pa.array(found, pa.int64())
            own = [batch.column(c).take(take) for c in (*names, "day", "value")]
            yield pa.RecordBatch.from_arrays([*own[:-2], pa.array(np.array(before, np.int32)), pa.array(values, pa.float64()), *own[-2:]], [*names, "day_a", "value_a", "day_b", "value_b"])

    end = lambda s: F.struct(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.date_from_unix_date(f"day_{s}").alias("date"), F.col(f"value_{s}").alias("value")).alias(s)
    return dealt.mapInArrow(sweep, schema).select(end("a"), end("b")).where(near(F.col("a.value"), F.col("b.value"), share)).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least of its class) of all nodes in ``edges`` (a, b), by alternating stars: larger neighbours are tied
    to the least, then smaller ones, until nothing changes. Rounds grow with the logarithm of a class. Each is written to
    scratch, and the least of a node is an aggregate that combines before the shuffle, so a node may have any number of edges."""
    edges = scratch.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """With edges from u to v: ties v to the least of u and its neighbours."""
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = down.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else down
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.join(least, "u")
        found = tied.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else tied.select(F.col("m").alias("a"), F.inline(F.array(F.struct(F.col("v").alias("b")), F.struct(F.col("u").alias("b")))))
        return found.where("a < b").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(edges)
    while True:
        edges = scratch.written(star(scratch.written(star(edges, True), name), False), name)
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def linked_events(events: DataFrame, keys: list[str], date: str, value: str, days: int, share: float = 0.01) -> DataFrame:
    """``events`` with event_date and event_value: the earliest day, and of that day the least value, of the class of
    statements that a row belongs to; its own where nothing links to it, and null without a key, date or value."""
    classes = components(links(events, keys, date, value, days, share))
    at = classes.select(*[F.col(f"node.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("node.date").alias("__d"), F.col("node.value").alias("__v"), F.col("root.date").alias("event_date"), F.col("root.value").alias("event_value"))
    same = [events[k] == at[f"__k{i}"] for i, k in enumerate(keys)]
    found = events.join(at, [*same, events[date] == at["__d"], events[value].cast("double") == at["__v"]], "left").drop("__d", "__v", *[f"__k{i}" for i in range(len(keys))])
    whole = F.col(date).isNotNull() & F.col(value).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return found.withColumn("event_date", F.when(whole, F.coalesce("event_date", date))).withColumn("event_value", F.when(whole, F.coalesce("event_value", F.col(value).cast("double"))))


def contested_lift(rows: DataFrame, event: list[str], value: str, truth: str, share: float = 0.01) -> DataFrame:
    """verdict (corroborated: all statements of the event within ``share`` of the row's; else contested), n, errors (the
    value differs from the truth), error_rate, elsewhere (errors whose truth another statement of the event has), lift (the
    rate over that of corroborated rows). Events with one statement, and rows without value or truth, take no part."""
    rows = rows.dropna(subset=[*event, value, truth])
    ends = rows.groupBy(*event).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.count("*").alias("__n")).where("__n > 1")
    stated = rows.select(*event, F.col(value).alias(truth), F.lit(True).alias("__found")).distinct()
    v = F.col(value)
    alike = (v - F.col("__low") <= share * F.greatest(F.abs(v), F.abs("__low"))) & (F.col("__high") - v <= share * F.greatest(F.abs(v), F.abs("__high")))
    wrong = v != F.col(truth)
    judged = rows.join(ends, event).join(stated, [*event, truth], "left").withColumn("verdict", F.when(alike, "corroborated").otherwise("contested"))
    found = judged.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.count_if(wrong & F.col("__found")).alias("elsewhere"))
    found = found.withColumn("error_rate", F.col("errors") / F.col("n"))
    base = found.where("verdict = 'corroborated'").select(F.col("error_rate").alias("__base"))
    return found.join(F.broadcast(base), how="left").select("verdict", "n", "errors", "elsewhere", "error_rate", F.try_divide("error_rate", F.when(F.col("__base") > 0, F.col("__base"))).alias("lift"))  # two rows and one
