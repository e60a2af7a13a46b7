"""Statistics as aggregations: tests, rank correlation, AUC, calibration, incidence, regression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def one_sample_t(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, mean, t against zero."""
    t = F.try_divide(F.avg(value), _nonzero(F.stddev_samp(value) / F.sqrt(F.count(value))))
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), t.alias("t"))


def welch_t(rows: DataFrame, value: str, first: Column, by: list[str] | None = None) -> DataFrame:
    """Difference of the means of rows where ``first`` holds and the others, and its t for unequal variances."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    error = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return rows.groupBy(*(by or [])).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), (F.avg(a) - F.avg(b)).alias("difference"), F.try_divide(F.avg(a) - F.avg(b), _nonzero(error)).alias("t"))


def paired_t(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return one_sample_t(rows.withColumn("__d", F.col(a) - F.col(b)), "__d", by)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 with ties given their mean."""
    tied = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (tied - 1) / 2


#: Rows that a task ranks on average.
RANKED = 500_000


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation within each group of ``by``. Rows are dealt once, by group, to tasks of about RANKED rows, so that what
    a task sorts does not grow with the table; one group's rows are sorted on disk where they do not fit."""
    known = rows.select(*by, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // RANKED))
    ranked = known.repartition(parts, *by).withColumn("__a", average_rank(a, by)).withColumn("__b", average_rank(b, by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__a", "__b").alias("rho"))


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b < value))
    row = F.greatest(below(F.array(*[F.lit(r[0]) for r in rows])), F.lit(1))
    within = F.element_at(F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows]), row)
    return (row - 1) * width + below(within)


def ranked_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct values ``v`` of each group with counts ``n`` (and other columns): adds upto, the group's rows up to each value,
    and mean_rank, the mean rank of its rows. Values are dealt to ranges, each range sums its own, and the totals of the
    ranges before are added: no task sees all of a group. The ranges' bounds are approximate percentiles, found first and
    then fixed, so that a value is in the same range wherever the plan asks; any bounds give the same ranks."""
    by = by or []
    part, own, total, before = _fresh(counts.columns, "part", "own", "total", "before")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = counts.agg(F.approx_percentile("v", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    ranged = counts.withColumn(part, range_of(F.col("v"), sorted(set(bounds or []))))
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = ranged.groupBy(*by, part).agg(F.sum("n").alias(total)).select(*by, part, F.coalesce(F.sum(total).over(ahead), F.lit(0)).alias(before))
    summed = ranged.withColumn(own, F.sum("n").over(Window.partitionBy(*by, part).orderBy("v")))
    found = summed.join(sums if by else F.broadcast(sums), [*by, part]).withColumn("upto", F.col(before) + F.col(own))
    return found.withColumn("mean_rank", F.col("upto") - (F.col("n") - 1) / 2).drop(part, own, before)


def _fresh(columns: list[str], *stems: str) -> list[str]:
    """Names like ``stems`` that no column has."""
    return [next(n for n in (f"__{s}" + "_" * i for i in range(len(columns) + 1)) if n.lower() not in {c.lower() for c in columns}) for s in stems]


def value_counts(rows: DataFrame, value: str, *more: Column, by: list[str] | None = None) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*(by or []), F.col(value).alias("v")).agg(F.count("*").alias("n"), *more)


def percentiles_by(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, p0, p1, ...: exact percentiles of each group, interpolated between the two values next to each. No task holds a
    group's values. Without ``by`` one row, of nulls where there are no values; groups are taken to have names, not nulls."""
    ranked, by = ranked_counts(value_counts(rows, value, by=by), by), by or []
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("__n"))
    placed = ranked.join(sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    at = lambda share, rounded: F.max(F.when((rounded(share * (F.col("__n") - 1)) + 1).between(F.col("upto") - F.col("n") + 1, F.col("upto")), F.col("v")))
    found = placed.groupBy(*by).agg(F.max("__n").alias("__n"), *[at(F.lit(s), f).alias(f"__{n}{i}") for i, s in enumerate(shares) for n, f in (("low", F.floor), ("high", F.ceil))])
    beyond = lambda share: (x := F.lit(share) * (F.col("__n") - 1)) - F.floor(x)
    return found.select(*by, *[(F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * beyond(s)).alias(f"p{i}") for i, s in enumerate(shares)])


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """The same of all rows, read by the driver."""
    return list(percentiles_by(rows, value, shares).first())


def binned_ranks(rows: DataFrame, value: str) -> DataFrame:
    """v, n, mean_rank of each distinct value, over all rows."""
    return ranked_counts(value_counts(rows, value)).drop("upto")


def auc(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """n, pos, area under the ROC curve from rank sums, ties counted half."""
    counts = value_counts(rows, score, F.count_if(label).alias("pos"))
    total = ranked_counts(counts).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * F.col("mean_rank")).alias("ranks"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return total.select("n", "pos", F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, _nonzero((pos * neg).cast("double"))).alias("auc"))


def calibration(rows: DataFrame, confidence: str, correct: Column, edges=(0.80, 0.90, 0.95, 0.98)) -> DataFrame:
    """bin (the number of edges at or below the confidence), n, mean_confidence, accuracy."""
    place = sum((F.col(confidence) >= e).cast("int") for e in edges)
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def incidence(rows: DataFrame, happened: Column, p: str) -> DataFrame:
    """Observed against expected counts when each row has a chance of its own, and the Poisson-binomial z."""
    observed, expected, variance = F.sum(happened.cast("int")), F.sum(p), F.sum(F.col(p) * (1 - F.col(p)))
    return rows.agg(observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, _nonzero(F.sqrt(variance))).alias("z"))


def gram(rows: DataFrame, y: str, xs: list[str]) -> dict:
    """Sums of products of (1, xs, y): one row, whatever the data."""
    names = ["1", *xs, y]
    term = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    rows = rows.dropna(subset=[*xs, y])
    sums = [F.sum(term(a) * term(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.agg(*sums).first().asDict()


def ols(rows: DataFrame, y: str, xs: list[str], ridge: float = 0.0) -> DataFrame:
    """term, coefficient, t of a regression with a constant: the products are summed by Spark and the small system is
    solved on the driver. ``ridge`` penalises all but the constant; t is then null."""
    import numpy as np

    sums, k = gram(rows, y, xs), len(xs) + 1
    full = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    xx, xy, n = full[:k, :k], full[:k, k], full[0, 0]
    penalty = ridge * np.eye(k)
    penalty[0, 0] = 0
    beta = np.linalg.solve(xx + penalty, xy)
    t = [None] * k
    if not ridge and n > k:
        error = (full[k, k] - beta @ xy) / (n - k)
        t = [float(b / s) if s > 0 else None for b, s in zip(beta, np.sqrt(np.maximum(error, 0) * np.diag(np.linalg.inv(xx))), strict=True)]
    made = [(name, float(b), tt) for name, b, tt in zip(["const", *xs], beta, t, strict=True)]
    return rows.sparkSession.createDataFrame(made, "term string, coefficient double, t double")
