"""Fitted models: a logistic hazard by Newton steps, and a ridge composite fitted on early rows and judged on late ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import ols, percentiles, welch_t

MOST_STEPS = 25


def person_periods(snapshots: DataFrame, events: DataFrame, keys: list[str], date: str, horizon: int, until) -> DataFrame:
    """``snapshots`` with past (events of the key on or before the day) and label (1.0 if one comes within ``horizon`` days
    after it, else 0.0). Snapshots whose horizon passes ``until``, the last day observed, are censored and left out.

    Events of one day count once. One union and one sort per key, no range join; rows without a date or key take no part.
    """
    marks = events.select(*keys, date).dropna().distinct().withColumn("__mark", F.lit(1))
    seen = snapshots.dropna(subset=[*keys, date]).where(F.date_add(date, horizon) <= F.lit(until))
    both = seen.withColumn("__mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy(F.col(date), F.col("__mark").desc())
    later = F.min(F.when(F.col("__mark") == 1, F.col(date))).over(window.rowsBetween(1, Window.unboundedFollowing))
    past = F.sum("__mark").over(window.rowsBetween(Window.unboundedPreceding, 0))
    label = F.coalesce(F.datediff(later, F.col(date)) <= horizon, F.lit(False)).cast("double")
    return both.withColumn("past", past).withColumn("label", label).where("__mark = 0").drop("__mark")


def _standardised(train: DataFrame, xs: list[str]) -> list[Column]:
    """Terms with mean 0 and deviation 1 over the rows; a constant one is 0."""
    made = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]).first()
    return [(F.col(x) - F.lit(made[f"mean{i}"])) / F.lit(made[f"sd{i}"]) if made[f"sd{i}"] else F.lit(0.0) for i, x in enumerate(xs)]


def _logit(terms: list[Column], beta) -> Column:
    found = F.lit(float(beta[0]))
    for z, b in zip(terms, beta[1:], strict=True):
        found = found + F.lit(float(b)) * z
    return found


def _newton(train: DataFrame, label: str, terms: list[Column], tolerance: float, most: int):
    """Coefficients (the constant first) and the inverse of the information. Each step is one aggregate: the sums of weighted
    products and of residuals, and the likelihood, by which a step that overshoots is halved."""
    k = len(terms) + 1
    named = train.select(F.col(label).cast("double").alias("y"), *[z.alias(f"z{i}") for i, z in enumerate(terms, 1)])
    z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(1, k)]]
    sums = [F.sum(F.col("w") * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum((F.col("y") - F.col("p")) * z[i]).alias(f"g{i}") for i in range(k)]
    # log(1 + exp(t)) without overflow
    t = F.col("t")
    sums.append(F.sum(F.col("y") * t - F.greatest(t, F.lit(0.0)) - F.log1p(F.exp(-F.abs(t)))).alias("fit"))

    def at(beta):
        p = 1 / (1 + F.exp(-F.col("t")))
        row = named.withColumn("t", _logit(z[1:], beta)).withColumn("p", p).withColumn("w", F.col("p") * (1 - F.col("p"))).agg(*sums).first()
        info = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return info, np.array([row[f"g{i}"] or 0.0 for i in range(k)]), row["fit"] or 0.0

    beta = np.zeros(k)
    info, slope, fit = at(beta)
    for _ in range(most):
        step = np.linalg.pinv(info) @ slope
        if np.abs(step).max() < tolerance:
            break
        while True:
            tried = at(beta + step)
            if tried[2] >= fit - 1e-9 * abs(fit) or np.abs(step).max() < tolerance:
                break
            step = step / 2
        beta, (info, slope, fit) = beta + step, tried
    return beta, np.linalg.pinv(info)


def logistic_terms(rows: DataFrame, label: str, xs: list[str], tolerance: float = 1e-8, most: int = MOST_STEPS) -> DataFrame:
    """term, coefficient (log-odds for one standard deviation), se, z of a logistic regression with a constant.

    Newton's steps by weighted sums: a step is one pass that returns one row, so nothing but the terms reaches the driver.
    Rows without the label or a term are left out. A constant term has coefficient 0 and null errors; where the labels can be
    separated the coefficients grow without end, and ``most`` steps are made.
    """
    train = rows.dropna(subset=[label, *xs])
    beta, inverse = _newton(train, label, _standardised(train, xs), tolerance, most)
    errors = np.sqrt(np.maximum(np.diag(inverse), 0))
    made = [(t, float(b), float(e) if e > 0 else None, float(b / e) if e > 0 else None) for t, b, e in zip(["const", *xs], beta, errors, strict=True)]
    return rows.sparkSession.createDataFrame(made, "term string, coefficient double, se double, z double")


def logistic_hazard(rows: DataFrame, label: str, xs: list[str], train: Column, tolerance: float = 1e-8, most: int = MOST_STEPS) -> DataFrame:
    """The rows outside ``train`` with hazard, the fitted chance of the label by a fit on those within."""
    rows = rows.dropna(subset=[label, *xs])
    early = rows.where(train)
    terms = _standardised(early, xs)
    beta, _ = _newton(early, label, terms, tolerance, most)
    return rows.where(~train).withColumn("hazard", 1 / (1 + F.exp(-_logit(terms, beta))))


def decile_lift(rows: DataFrame, score: str, label: str, n: int = 10) -> DataFrame:
    """decile (1 the highest scores), n, rate, lift over the whole rate. Cuts are exact percentiles from ranks over ranges of
    scores, so neither a window nor a buffer holds all of them."""
    cuts = percentiles(rows, score, [i / n for i in range(1, n)])
    base = rows.agg(F.avg(label)).first()[0]
    place = n - sum((F.col(score) > c).cast("int") for c in cuts)
    return rows.groupBy(place.cast("int").alias("decile")).agg(F.count("*").alias("n"), F.avg(label).alias("rate")).withColumn("lift", F.try_divide("rate", F.lit(base)))


def ridge_composite(rows: DataFrame, y: str, xs: list[str], train: Column, ridge: float = 10.0) -> DataFrame:
    """Rows outside ``train`` with composite: the ridge prediction from terms fitted on ``train``. Its strength is ours; the source leaves it open."""
    terms = {r["term"]: r["coefficient"] for r in ols(rows.where(train), y, xs, ridge=ridge).collect()}  # one row per term
    composite = F.lit(terms["const"])
    for x in xs:
        composite = composite + F.lit(terms[x]) * F.col(x)
    return rows.where(~train).withColumn("composite", composite)


def quintiles(rows: DataFrame, value: str, by: list[str], n: int = 5) -> DataFrame:
    """Equal counts within each group, ties by row order of the value."""
    return rows.withColumn("bucket", F.ntile(n).over(Window.partitionBy(*by).orderBy(value)))


def spread(rows: DataFrame, y: str, bucket: str = "bucket", n: int = 5) -> DataFrame:
    """Mean of ``y`` in the highest bucket less that in the lowest, with Welch's t."""
    return welch_t(rows.where(F.col(bucket).isin(1, n)), y, F.col(bucket) == n)
