"""Scoring of extractions against hand labels: field outcomes, alignment of lists, tallies, runs and champions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.scalar import outcome
from ..functions.text import normalize
from . import matching

OUTCOMES = ("correct", "wrong", "missed", "hallucinated")
DETECTION = "trade_detection"
#: A pair must agree, both sides stated, on as many identity fields, one of them strong.
LEAST_IDENTITY = 2


@dataclass(frozen=True)
class Field:
    """A scored field; text is compared normalised, all else by value."""

    name: str
    text: bool = False
    identity: bool = False
    strong: bool = False


def comparable(rows: DataFrame, keys: list, fields: Sequence[Field], name: str) -> DataFrame:
    """keys and a struct of the fields, text normalised: done once per row, so that comparing pairs is plain equality."""
    values = [normalize(F.col(f.name)).alias(f.name) if f.text else F.col(f.name) for f in fields]
    return rows.select(*keys, F.struct(*values).alias(name))


def _outcomes(fields: Sequence[Field]) -> list[Column]:
    return [F.struct(F.lit(f.name).alias("field"), outcome(F.col("__g")[f.name], F.col("__p")[f.name]).alias("outcome")) for f in fields]


def score_fields(golden: DataFrame, stated: DataFrame, keys: list[str], fields: Sequence[Field]) -> DataFrame:
    """keys, field, outcome: one row per field of every labelled document that has a prediction."""
    both = comparable(golden, keys, fields, "__g").join(comparable(stated, keys, fields, "__p"), keys)
    return both.select(*keys, F.inline(F.array(*_outcomes(fields))))


def skipped(golden: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """n_documents scored and n_skipped for want of a prediction."""
    there = stated.select(*keys, F.lit(True).alias("__there")).distinct()
    return golden.select(*keys).distinct().join(there, keys, "left").agg(F.count_if("__there").alias("n_documents"), F.count_if(F.col("__there").isNull()).alias("n_skipped"))


def listed(golden: DataFrame, stated: DataFrame | None, key: str, fields: Sequence[Field]) -> DataFrame:
    """key, side, i, v: the items of both lists with their places and a struct of the fields, text normalised. Without ``stated``,
    ``golden`` has both, told apart by ``side`` (0 or 1)."""
    rows = golden if stated is None else matching.sides(golden, stated)
    return comparable(rows, [key, "side", F.col("idx").cast("int").alias("i")], fields, "v")


def _told(fields: Sequence[Field]):
    """Of two values: the outcomes of all fields, one letter each."""
    return lambda g, p: F.concat(*[F.substring(outcome(g[f.name], p[f.name]), 1, 1) for f in fields])


def _matched(golden: DataFrame, stated: DataFrame | None, key: str, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    equal = F.lit("c" * len(fields))  # equal items are correct in every field
    return matching.match(listed(golden, stated, key, fields), [key], fields, LEAST_IDENTITY, _told(fields), equal)


def match(golden: DataFrame, stated: DataFrame | None, key: str, fields: Sequence[Field]) -> DataFrame:
    """key, g, p of the matched pairs: most agreement first, then identity, then list order."""
    return _matched(golden, stated, key, fields)[0].select(key, "g", "p")


def score_lists(golden: DataFrame, stated: DataFrame | None, key: str, fields: Sequence[Field]) -> DataFrame:
    """key, field, outcome: detection of every labelled and stated item, and the fields of matched pairs. Documents that
    lack a prediction altogether belong in ``skipped`` and are left out."""
    pairs, sizes = _matched(golden, stated, key, fields)
    pairs = scratch.written(pairs, "matched")
    names = F.create_map(*[F.lit(x) for o in OUTCOMES for x in (o[0], o)])
    scored = F.array(F.struct(F.lit(DETECTION).alias("field"), F.lit("correct").alias("outcome")), *[F.struct(F.lit(f.name).alias("field"), names[F.substring("told", i + 1, 1)].alias("outcome")) for i, f in enumerate(fields)])
    sizes = sizes.where("n_stated > 0").join(pairs.groupBy(key).agg(F.count("*").alias("__m")), key, "left").na.fill(0, ["__m"])
    times = lambda outcome, n: F.array_repeat(F.struct(F.lit(DETECTION).alias("field"), F.lit(outcome).alias("outcome")), n.cast("int"))
    others = sizes.select(key, F.inline(F.concat(times("missed", F.col("n_golden") - F.col("__m")), times("hallucinated", F.col("n_stated") - F.col("__m")))))
    return pairs.select(key, F.inline(scored)).unionByName(others)


def _counts(sizes: DataFrame, counted: DataFrame, keys: list[str], fields: Sequence[Field]) -> DataFrame:
    """keys, field, outcome, n, of what was counted by keys: sizes in columns, other pairs by what is told of them."""
    sums = [F.sum(F.when(F.substring("told", i + 1, 1) == o[0], F.col("n"))).alias(f"__{o}{i}") for i in range(len(fields)) for o in OUTCOMES]
    told = counted.groupBy(*keys).agg(F.sum("n").alias("__m"), *sums)
    both = (sizes.join(told, keys, "left") if keys else sizes.crossJoin(told)).na.fill(0).withColumn("__m", F.col("__m") + F.col("n_equal"))
    row = lambda field, what, n: F.struct(F.lit(field).alias("field"), F.lit(what).alias("outcome"), n.alias("n"))
    detection = [row(DETECTION, "correct", F.col("__m")), row(DETECTION, "missed", F.col("n_golden") - F.col("__m")), row(DETECTION, "hallucinated", F.col("n_stated") - F.col("__m"))]
    of = lambda o, i: F.col(f"__{o}{i}") + F.col("n_equal") if o == "correct" else F.col(f"__{o}{i}")
    rows = F.array(*detection, *[row(f.name, o, of(o, i)) for i, f in enumerate(fields) for o in OUTCOMES])
    return both.select(*keys, F.inline(rows)).where("n > 0")


def count_lists(golden: DataFrame, stated: DataFrame | None, key: str, fields: Sequence[Field]) -> DataFrame:
    """key, field, outcome, n of what ``score_lists`` gives. Pairs are counted in columns by key, and rows made of the counts,
    so that one row a pair and not one a field goes through the shuffle; of equal items only their number does."""
    counted, sizes = matching.counted(listed(golden, stated, key, fields), [key], fields, LEAST_IDENTITY, _told(fields))
    return _counts(sizes.where("n_stated > 0"), counted, [key], fields)


def total_lists(golden: DataFrame, stated: DataFrame | None, key: str, fields: Sequence[Field]) -> DataFrame:
    """field, outcome, n over all documents: the sums of what ``count_lists`` gives. Pairs lie in documents that have a
    prediction, so they are summed up at once and not by document."""
    counted, sizes = matching.counted(listed(golden, stated, key, fields), [key], fields, LEAST_IDENTITY, _told(fields))
    totals = sizes.where("n_stated > 0").agg(*[F.sum(c).alias(c) for c in sizes.columns if c != key])
    return _counts(totals, counted, [], fields)


def tally(outcomes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """position, field, the four counts, total, accuracy for every field in report order; null accuracy where nothing was scored.
    Outcomes are rows of field and outcome, or have their number in n."""
    report = outcomes.sparkSession.createDataFrame(list(enumerate(fields)), "position int, field string")
    number = F.col("n") if "n" in outcomes.columns else F.lit(1).cast("long")
    counts = outcomes.groupBy("field").agg(*[F.sum(F.when(F.col("outcome") == o, number)).alias(o) for o in OUTCOMES])
    rows = report.join(counts, "field", "left").na.fill(0, list(OUTCOMES))
    total = sum(F.col(o) for o in OUTCOMES)
    return rows.withColumn("total", total).withColumn("accuracy", F.try_divide("correct", F.nullif("total", F.lit(0).cast("long")))).select("position", "field", *OUTCOMES, "total", "accuracy")


def evaluation_run(tallied: DataFrame) -> DataFrame:
    """One row: overall accuracy (over all outcomes, not the mean of ratios) and the fields' scores as an ordered list."""
    score = F.struct("position", "field", *OUTCOMES, "total", "accuracy")
    ordered = F.transform(F.array_sort(F.collect_list(score)), lambda s: s.dropFields("position"))
    return tallied.agg(F.try_divide(F.sum("correct"), F.nullif(F.sum("total"), F.lit(0).cast("long"))).alias("overall_accuracy"), ordered.alias("field_scores"))


def champions(runs: DataFrame, group: list[str]) -> DataFrame:
    """The run of greatest (accuracy, version) of each group; runs without accuracy cannot win."""
    rest = [c for c in runs.columns if c not in group]
    return runs.where("accuracy is not null").groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct("accuracy", "version")).alias("__r")).select(*group, "__r.*")


def version_moves(runs: DataFrame, group: list[str], flat: float = 0.02) -> DataFrame:
    """Each run with the change from the version just before it, null where that version has no run, and its kind."""
    window = Window.partitionBy(*group).orderBy("version")
    before = F.when(F.lag("version").over(window) == F.col("version") - 1, F.lag("accuracy").over(window))
    runs = runs.withColumn("change", F.col("accuracy") - before)
    return runs.withColumn("move", F.when(F.col("change").isNull(), "first").when(F.abs("change") < flat, "flat").when(F.col("change") > 0, "up").otherwise("down"))
