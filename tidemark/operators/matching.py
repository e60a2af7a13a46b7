"""Greedy one-to-one matching by rounds of locally dominant edges, and what agreement makes an edge.

Walking all candidate pairs from the best on, and taking each whose two ends are free, gives the same matching as taking, again
and again, every pair that is the best left for both its ends: the order is strict, so the best pair of all is always taken, and
no pair that is best for both its ends can lose one of them to a better pair. Such rounds need no order over all pairs, so a
document of any size is many keys and not one row or one task. Most pairs are decided in the first rounds.

Equal items are one class, so copies do not multiply pairs: two classes that are the best of each other, with no other pair of
that rank at either, pair their items in order all at once, as the walk would. Only items whose classes are tied are then told
apart by their places, pair by pair. Counts of pairs are made of classes and need no places.

Candidates are found by hash joins. A document with few classes left is one key, and its classes are compared with each other, so
that one shuffle serves the join and all that a round looks at; in larger ones there is a join on each strong field and
never a trial of all pairs, and rounds are dealt by the ends.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch

#: Items of classes of several up to which these are broadcast and not dealt by key.
BROADCAST_ITEMS = 100_000
#: Classes of a document, beyond those of equal items, up to which all of its pairs are tried: 256 at most.
FEW_CLASSES = 32


def dominant(edges: DataFrame, left: list[str], right: list[str], order: list[str], most_rounds: int = 200) -> DataFrame:
    """The edges that a greedy walk in ascending ``order`` takes, where each of the ends ``left`` and ``right`` is taken once.

    ``order`` has to be strict among the edges of an end; ties are broken by the ends."""
    rank = F.struct(*order, *[c for c in dict.fromkeys([*left, *right]) if c not in order])
    ends = lambda columns: Window.partitionBy(*columns)
    rest = scratch.written(edges, "edges")
    taken = None
    for _ in range(most_rounds):
        ranked = rest.withColumn("__rank", rank).withColumn("__left", F.min("__rank").over(ends(left))).withColumn("__right", F.min("__rank").over(ends(right)))
        best = ranked.withColumn("__best", (F.col("__rank") == F.col("__left")) & (F.col("__rank") == F.col("__right")))
        # an end is gone if one of its edges is taken
        gone = best.withColumn("__r", F.max("__best").over(ends(right))).withColumn("__l", F.max("__best").over(ends(left)))
        step = scratch.written(gone.where("__best or not (__l or __r)").select(*edges.columns, "__best"), "edges")
        now = step.where("__best").drop("__best")
        taken = now if taken is None else taken.unionByName(now)
        rest = step.where("not __best").drop("__best")
        if rest.isEmpty():
            return taken
    raise RuntimeError("the rounds did not end")


def sides(golden: DataFrame, stated: DataFrame) -> DataFrame:
    """Both as one frame, with ``side`` 0 or 1."""
    return golden.withColumn("side", F.lit(0)).unionByName(stated.withColumn("side", F.lit(1)))


def classes(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v, A, ta, B, tb: for each value the least place on either side and how many items have it. Items that come dealt by
    their keys stay so."""
    of = lambda n, what: what(F.when(F.col("side") == n, F.col("i")))
    return items.groupBy(*keys, "v").agg(of(0, F.min).alias("A"), of(0, F.count).alias("ta"), of(1, F.min).alias("B"), of(1, F.count).alias("tb"))


def places(items: DataFrame, large: DataFrame, keys: list[str], head: str) -> DataFrame:
    """keys, ``head``, r, i: the items of classes of several, numbered from 1 within each."""
    own = items.join(large.select(*keys, "v", head), [*keys, "v"])
    return own.select(*keys, head, "i", F.row_number().over(Window.partitionBy(*keys, head).orderBy("i")).cast("long").alias("r"))


def may_match(value: Column, fields: Sequence, least: int) -> Column:
    """Has an item ``least`` identity fields and a strong one at all?"""
    known = lambda f: value[f.name].isNotNull()
    return (sum(known(f).cast("int") for f in fields if f.identity) >= least) & functools.reduce(Column.__or__, [known(f) for f in fields if f.strong])


def settled(known: DataFrame, fields: Sequence, least: int) -> DataFrame:
    """The classes with n, their pairs of equal items, which rank above all others. Of one item a side that are such a pair
    nothing is left to compare, so their value is dropped."""
    counted = known.withColumn("n", F.when(may_match(F.col("v"), fields, least), F.least("ta", "tb")).otherwise(0).cast("long"))
    return counted.withColumn("v", F.when(F.greatest("ta", "tb") > F.least(F.col("n"), F.lit(1)), F.col("v")))


def untied(edges: DataFrame, keys: list[str], by_key: bool = False, most_rounds: int = 50) -> tuple[DataFrame, DataFrame | None]:
    """(what is taken, what is left or None) of edges between classes A and B (columns __grade; A, B; na, nb: free items; ua, ub:
    items used). An edge that is the best of both its classes, with no other of its rank at either, pairs as many of their items
    as it can, in order. ``by_key``: deal by key and not by class."""
    at = lambda side: Window.partitionBy(*keys, side)
    used = [c for c in edges.columns if c not in ("ua", "ub", "na", "nb")]
    rest, taken = edges, None
    for _ in range(most_rounds):
        seen = rest.repartition(*keys) if by_key else rest
        for side in ("A", "B"):
            seen = seen.withColumn(f"__best{side}", F.min("__grade").over(at(side)))
            seen = seen.withColumn(f"__ties{side}", F.count_if(F.col("__grade") == F.col(f"__best{side}")).over(at(side)))
        first = (F.col("__grade") == F.col("__bestA")) & (F.col("__grade") == F.col("__bestB")) & (F.col("__tiesA") == 1) & (F.col("__tiesB") == 1)
        seen = seen.withColumn("n", F.when(first, F.least("na", "nb")).otherwise(0))
        spent = seen.withColumn("__sb", F.sum("n").over(at("B"))).withColumn("__sa", F.sum("n").over(at("A")))
        step = scratch.written(spent.where("n > 0 or na > __sa and nb > __sb").select(*edges.columns, "n", "__sa", "__sb"), "class-edges")
        now = step.where("n > 0").select(*edges.columns, "n")
        rest = step.where("n = 0").select(*used, *[(F.col(c) + F.col(d)).alias(c) for c, d in (("ua", "__sa"), ("ub", "__sb"))], (F.col("na") - F.col("__sa")).alias("na"), (F.col("nb") - F.col("__sb")).alias("nb"))
        n, left = step.agg(F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 0)).first()
        taken = now if taken is None else taken.unionByName(now)
        if not n or not left:
            break
    return taken, rest if left else None


def _same(name: str) -> Column:
    return F.coalesce(F.col("gv")[name] == F.col("pv")[name], F.lit(False))


def _ranked(pairs: DataFrame, fields: Sequence, least: int) -> DataFrame:
    """The pairs that agree, both sides stated, on ``least`` identity fields, with their rank: agreement and then identity, most first."""
    identity = [f for f in fields if f.identity]
    both_null = lambda name: F.col("gv")[name].isNull() & F.col("pv")[name].isNull()
    agreement = sum((_same(f.name) | both_null(f.name)).cast("int") for f in fields)
    found = pairs.withColumn("__identity", sum(_same(f.name).cast("int") for f in identity)).where(F.col("__identity") >= least)
    return found.withColumn("__grade", -(agreement * (len(identity) + 1) + F.col("__identity"))).drop("__identity")


def candidates(golden: DataFrame, stated: DataFrame, keys: list[str], fields: Sequence, least: int) -> DataFrame:
    """The rows of both, with their rank, that agree, both sides stated, on a strong field and on ``least`` identity fields
    in all. golden: keys, gv and more; stated: keys, pv and more. One hash join per strong field; a pair that agrees on
    several is found by the first."""
    strong = [f.name for f in fields if f.strong]
    found = []
    for at, name in enumerate(strong):
        a, b = golden.withColumn("__on", F.col("gv")[name]), stated.withColumn("__on", F.col("pv")[name])
        pairs = a.join(b, [*keys, "__on"]).drop("__on")
        for before in strong[:at]:
            pairs = pairs.where(~_same(before))
        found.append(_ranked(pairs, fields, least))
    return functools.reduce(DataFrame.unionByName, found)


def few_candidates(golden: DataFrame, stated: DataFrame, keys: list[str], fields: Sequence, least: int) -> DataFrame:
    """The same, for documents of few rows, by one join on the keys; so the result is dealt by them."""
    pairs = golden.join(stated, keys)
    return _ranked(pairs.where(functools.reduce(Column.__or__, [_same(f.name) for f in fields if f.strong])), fields, least)


def _edges(items: DataFrame, keys: list[str], fields: Sequence, least: int, told: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(classes; edges taken between classes that are not equal, each of n pairs; edges between tied classes, or None)."""
    known = scratch.written(settled(classes(items, keys), fields, least), "classes")
    left = known.where("greatest(ta, tb) > n")
    open_classes = left.where(may_match(F.col("v"), fields, least))
    heads = lambda rows, head, total, used, free, value: rows.where(F.col(total) > F.col("n")).select(*keys, head, total, F.col("n").alias(used), (F.col(total) - F.col("n")).alias(free), F.col("v").alias(value))
    many = scratch.written(left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > FEW_CLASSES).select(*keys), "long-documents")

    def decided(rows: DataFrame, find: Callable, by_key: bool) -> tuple[DataFrame, DataFrame | None]:
        found = find(heads(rows, "A", "ta", "ua", "na", "gv"), heads(rows, "B", "tb", "ub", "nb", "pv"), keys, fields, least)
        return untied(found.withColumn("told", told(F.col("gv"), F.col("pv"))).drop("gv", "pv"), keys, by_key)

    if many.isEmpty():
        return known, *decided(open_classes, few_candidates, True)
    short, long = decided(open_classes.join(many, keys, "left_anti"), few_candidates, True), decided(open_classes.join(many, keys, "left_semi"), candidates, False)
    rest = [r for _, r in (short, long) if r is not None]
    return known, short[0].unionByName(long[0]), functools.reduce(DataFrame.unionByName, rest) if rest else None


def _numbered(items: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """(keys, A, ra, g; keys, B, rb, p) of the items of classes of several; None if every class is one item."""
    large = scratch.written(known.where("ta > 1 or tb > 1"), "large-classes")
    n_large = large.agg(F.sum(F.col("ta") + F.col("tb"))).first()[0]
    if not n_large:
        return None
    few = F.broadcast if n_large <= BROADCAST_ITEMS else lambda rows: rows  # of one row a class and item
    return tuple(few(places(items.where(F.col("side") == n), few(large), keys, head).select(*keys, head, F.col("r").alias(r), F.col("i").alias(i))) for n, head, r, i in ((0, "A", "ra", "g"), (1, "B", "rb", "p")))


def _item(rows: DataFrame) -> DataFrame:
    return rows.withColumn("g", F.coalesce("g", "A")).withColumn("p", F.coalesce("p", "B"))


def _walked(rest: DataFrame, numbered: tuple[DataFrame, DataFrame] | None, keys: list[str]) -> DataFrame:
    """keys, g, p, told of what the walk takes of the items of tied classes."""
    if numbered is None:  # every class is named by its place
        tied = rest.withColumn("g", F.col("A")).withColumn("p", F.col("B"))
    else:
        a, b = numbered
        tied = _item(rest.join(a, [*keys, "A"], "left").where("ra is null or ra > ua").join(b, [*keys, "B"], "left").where("rb is null or rb > ub"))
    tied = tied.select(*keys, "g", "p", "told", "__grade")
    return dominant(tied, [*keys, "g"], [*keys, "p"], ["__grade", "g", "p"]).drop("__grade")


def _sizes(known: DataFrame, keys: list[str]) -> DataFrame:
    return known.groupBy(*keys).agg(F.sum("ta").alias("n_golden"), F.sum("tb").alias("n_stated"), F.sum("n").alias("n_equal"))


def counted(items: DataFrame, keys: list[str], fields: Sequence, least: int, told: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(keys, told, n: pairs of items that are not equal, by what ``told`` says of their values, not summed up; keys, n_golden,
    n_stated, n_equal). items: keys, side, i, v."""
    known, taken, rest = _edges(items, keys, fields, least, told)
    pairs = taken.select(*keys, "told", "n")
    if rest is not None:
        pairs = pairs.unionByName(_walked(rest, _numbered(items, known, keys), keys).select(*keys, "told", F.lit(1).cast("long").alias("n")))
    return pairs, _sizes(known, keys)


def match(items: DataFrame, keys: list[str], fields: Sequence, least: int, told: Callable[[Column, Column], Column], equal: Column) -> tuple[DataFrame, DataFrame]:
    """(keys, g, p, told of the matched pairs; sizes as in ``counted``): most agreement first, then identity, then list order.
    items: keys, side, i, v. Pairs of equal items are told ``equal``."""
    known, taken, rest = _edges(items, keys, fields, least, told)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alike = known.where("n > 0").select(*keys, "A", "B", "ta", "tb", zero.alias("ua"), zero.alias("ub"), "n", equal.alias("told"))
    each = alike.unionByName(taken.select(*alike.columns))
    numbered = _numbered(items, known, keys)
    # two classes of one item are named by their places; of others the k-th free item of one goes to the k-th of the other
    pairs = (each if numbered is None else each.where("ta = 1 and tb = 1")).select(*keys, F.col("A").alias("g"), F.col("B").alias("p"), "told")
    if numbered is not None:
        a, b = numbered
        several = each.where("ta > 1 or tb > 1").withColumn("__k", F.explode(F.sequence(one, F.col("n")))).withColumn("ra", F.col("ua") + F.col("__k")).withColumn("rb", F.col("ub") + F.col("__k"))
        pairs = pairs.unionByName(_item(several.join(a, [*keys, "A", "ra"], "left").join(b, [*keys, "B", "rb"], "left")).select(*keys, "g", "p", "told"))
    if rest is not None:
        pairs = pairs.unionByName(_walked(rest, numbered, keys))
    return pairs, _sizes(known, keys)
