"""Operator 7: a quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the whole text. Normal equations
are summed per partition and then over partitions, by fold; ridge weights solve them. Scores of each training fold by
the other fold's weights are gathered in equal-width bins, and isotonic regression of the labels on them (adjacent
violators pooled) turns raw scores into probabilities, interpolated between the steps.

Learnt from rows whose crc32 of the doc_id's text leaves a remainder other than ``HELD_OUT`` by 3; the two other
remainders are the folds. Labels are averaged per doc_id, and null labels are left out. Up to about ``MOST_LABELS``
labelled rows, chosen by hash over all of them, are learnt from; every document is scored, also empty and null texts.
Without labels every score is 0.5. Repeated rows get equal scores; an empty table gives an empty result.
Statistics are of the whole text, however long. Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HELD_OUT, FOLDS = 1, (0, 2)
FOURIER, RIDGE, SEED = 256, 1.0, 11
MOST_LABELS, BINS = 200_000, 400
#: Partitions that sum the normal equations at most: each sends the driver half a megabyte per fold.
SUMMING_PARTS = 32
#: Raw scores are binned over this range; labels are 0 and 1.
RANGE = (-0.5, 1.5)

STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "digits", "upper", "symbols", "other_punctuation", "not_ascii",
    "unique_words", "unique_windows", "repeated_lines", "mean_line", "bare_marks", "shouted", "top_word",
)
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS, _PUNCTUATION = b"#*$%&|<>", b".,;:!?'\"()-"
_BARE = re.compile(rb"[^A-Za-z0-9\x80-\xff]+")


def statistics(text: str) -> list[float]:
    """Of the whole text, in the order of ``STATISTICS``; all zero without words."""
    body = text.encode()
    words = body.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(body), len(words)
    without = lambda kinds: (size - len(body.translate(None, kinds))) / size
    lines = [x for x in body.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    windows = set(zip(words, words[1:], words[2:], strict=False))
    bare = sum(c for w, c in counts.items() if _BARE.fullmatch(w))
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(len(text)), math.log1p(n), sum(map(len, words)) / n, math.log1p(max(map(len, counts))), without(_DIGITS), without(_UPPER), without(_SYMBOLS), without(_PUNCTUATION), (size - len(text)) / size,
        len(counts) / n, len(windows) / max(1, n - 2), 1 - len(set(lines)) / len(lines), math.log1p(size / len(lines)), bare / n, shouted / n, max(counts.values()) / n,
    ]


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one double per statistic."""
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches):
        return common.record_batches(((doc_id, *statistics(body or "")) for doc_id, body in common.batch_rows(batches)), schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def fold(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)).cast("int")


@dataclass
class Fourier:
    """Standardisation and the random directions of the kernel's spectrum."""

    mean: list[float]
    scale: list[float]
    seed: int = SEED

    def __call__(self, x):
        import numpy as np

        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        directions = rng.standard_normal((d, FOURIER)) / math.sqrt(d)  # kernel width: the square root of the dimension
        phases = rng.uniform(0, 2 * math.pi, FOURIER)
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6)
        return np.concatenate([math.sqrt(2 / FOURIER) * np.cos(z @ directions + phases), np.ones((len(x), 1))], axis=1)


def _matrix(batch, names):
    import numpy as np

    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def normal_equations(rows: DataFrame, fourier: Fourier) -> dict[int, tuple]:
    """(Z'Z, Z'y) by fold. Each partition sends one pair per fold, whose size does not depend on the rows."""
    import numpy as np

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            z, y, folds = fourier(_matrix(batch, STATISTICS)), batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(folds):
                own = folds == f
                part = sums.setdefault(int(f), [0, 0])
                part[0] = part[0] + z[own].T @ z[own]
                part[1] = part[1] + z[own].T @ y[own]
        return common.record_batches(((f, a.tobytes(), b.tobytes()) for f, (a, b) in sums.items()), "fold int, gram binary, moment binary")

    found = {f: (np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1)) for f in FOLDS}
    for f, gram, moment in rows.coalesce(SUMMING_PARTS).mapInArrow(run, "fold int, gram binary, moment binary").orderBy("fold").toLocalIterator():
        found[f] = (found[f][0] + np.frombuffer(gram).reshape(FOURIER + 1, -1), found[f][1] + np.frombuffer(moment))
    return found


def ridge(gram, moment):
    import numpy as np

    penalty = RIDGE * np.eye(len(moment))
    penalty[-1, -1] = 1e-6  # the constant is not shrunk
    return np.linalg.solve(gram + penalty, moment)


def isotonic(bins: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Points (raw score, probability) from (score, rows, sum of labels), ascending: adjacent violators are pooled."""
    pools: list[list[float]] = []
    for score, n, total in sorted(bins):
        pools.append([score * n, n, total])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            s, n, total = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + total]
    return [s / n for s, n, _ in pools], [t / n for _, n, t in pools]


@dataclass
class Model:
    fourier: Fourier
    weights: object
    xs: list[float]
    ps: list[float]

    def score(self, x):
        """From 0 to 1. Ties of the steps are broken by the raw score, which moves a probability by 0.005 at most."""
        import numpy as np

        raw = self.fourier(x) @ self.weights
        share = np.clip((raw - RANGE[0]) / (RANGE[1] - RANGE[0]), 0, 1)
        return np.clip(0.99 * np.interp(raw, self.xs, self.ps) + 0.01 * share, 0, 1)


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model | None:
    """``features``: doc_id, the statistics. None without labelled rows to learn from."""
    labels = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    labels = labels.where(fold() != HELD_OUT)
    share = MOST_LABELS / max(1, labels.count())
    if share < 1:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = common.written(features.join(labels, "doc_id").withColumn("fold", fold()), "labelled")
    sums = [f(s).alias(f"{n}_{s}") for s in STATISTICS for n, f in (("mean", F.avg), ("scale", F.stddev_pop))]
    moments = rows.agg(F.count("*").alias("n"), *sums).first()
    if not moments["n"]:
        return None
    fourier = Fourier([moments[f"mean_{s}"] for s in STATISTICS], [moments[f"scale_{s}"] or 1.0 for s in STATISTICS])
    equations = normal_equations(rows, fourier)
    by_other = {f: ridge(*equations[FOLDS[1 - i]]) for i, f in enumerate(FOLDS)}
    weights = ridge(*(sum(equations[f][i] for f in FOLDS) for i in (0, 1)))
    schema = "bin int, label double"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            z, folds = fourier(_matrix(batch, STATISTICS)), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.where(folds == FOLDS[0], z @ by_other[FOLDS[0]], z @ by_other[FOLDS[1]])
            bins = np.clip((raw - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], ["bin", "label"])

    width = (RANGE[1] - RANGE[0]) / BINS
    found = rows.mapInArrow(run, schema).groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("total")).collect()  # at most BINS rows
    return Model(fourier, weights, *isotonic([(RANGE[0] + (r["bin"] + 0.5) * width, r["n"], r["total"]) for r in found]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    features = common.written(with_statistics(docs, key, text), "statistics")
    model = fit(features, labels, key, label)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x)) if model else pa.array([0.5] * len(x))], ["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
