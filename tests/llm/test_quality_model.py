"""Operator 7: isotonic regression, the normal equations, folds and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality_model as qm

DIR = "/root/testdata/sf0.01"


def test_isotonic():
    xs, ps = qm.isotonic([(0.1, 10, 1), (0.2, 10, 5), (0.3, 10, 3), (0.4, 10, 9), (0.5, 10, 9)])
    assert ps == sorted(ps) and ps == [0.1, 0.4, 0.9] and xs[1] == pytest.approx(0.25)
    rng = random.Random(1)
    bins = [(i / 50, 1 + rng.randint(0, 9), 0) for i in range(50)]
    bins = [(x, n, rng.randint(0, n)) for x, n, _ in bins]
    _, ps = qm.isotonic(bins)
    # the least-squares monotone fit by its min-max formula
    means = lambda a, b: sum(t for _, _, t in bins[a : b + 1]) / sum(n for _, n, _ in bins[a : b + 1])
    fit = [max(min(means(a, b) for b in range(i, 50)) for a in range(i + 1)) for i in range(50)]
    assert sorted({round(p, 9) for p in ps}) == sorted({round(p, 9) for p in fit})


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    d = len(qm.STATISTICS)
    x, y = rng.normal(size=(40, d)), rng.normal(size=(40, d))
    f = qm.Fourier([0.0] * d, [1.0] * d)
    wanted = np.exp(-((x - y) ** 2).sum(1) / (2 * d))
    assert np.abs((f(x)[:, :-1] * f(y)[:, :-1]).sum(1) - wanted).mean() < 0.08


def test_statistics_of_odd_texts():
    assert qm.statistics("") == qm.statistics(" \n ") == [0.0] * len(qm.STATISTICS)
    for text in ("one", "É É", "AB !! ## x", "a\n\na", "w " * 100_000):
        assert all(np.isfinite(qm.statistics(text)))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    found = {r["doc_id"]: r for r in qm.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [i for i in truth if i in found and found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == truth[i] for i in held]) > 0.95


def test_odd_tables(spark):
    texts = [None, "", "clean words of prose " * 20, "### $$$ %%% " * 20] * 12
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(2, texts[2], 0.5, 1), (None, "x", 0.5, 1)], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, int(i % 4 == 2)) for i in range(40)] + [(1, None), (0, 0)], "doc_id long, quality int")
    rows = qm.classify(docs, labels).collect()
    assert len(rows) == 50 and {r["predicted"] for r in rows if r["doc_id"] is not None and r["doc_id"] % 4 == 2} == {1}
    none = qm.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert qm.classify(docs.limit(0), labels).count() == 0


def test_fit_against_a_dense_solve(spark):
    """The whole fit, over many partitions, against plain matrices of all rows."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["word", "Other", "###", "12", "é", "a,b"]) for _ in range(rng.randint(1, 80))) + "\nline" * rng.randint(0, 4) for _ in range(300)]
    labels = {i: float(rng.random() < 0.2 + 0.6 * (texts[i].count("#") < 20)) for i in range(0, 300, 2)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    features = qm.with_statistics(docs)
    model = qm.fit(features, spark.createDataFrame([(i, int(y)) for i, y in labels.items()], "doc_id long, quality int"))

    fold = {i: zlib.crc32(str(i).encode()) % 3 for i in range(300)}
    learnt = [i for i in labels if fold[i] != qm.HELD_OUT]
    x = np.array([qm.statistics(t) for t in texts])
    mean, scale = x[learnt].mean(axis=0), x[learnt].std(axis=0)
    scale[scale == 0] = 1.0
    draw = np.random.default_rng(qm.SEED)
    directions = draw.standard_normal((x.shape[1], qm.FOURIER)) / np.sqrt(x.shape[1])
    phases = draw.uniform(0, 2 * np.pi, qm.FOURIER)
    z = np.hstack([np.sqrt(2 / qm.FOURIER) * np.cos(np.clip((x - mean) / scale, -6, 6) @ directions + phases), np.ones((300, 1))])
    y = np.array([labels.get(i, np.nan) for i in range(300)])

    def solved(rows):
        """Ridge as a least-squares problem with the penalty as extra rows."""
        extra = np.sqrt(qm.RIDGE) * np.eye(qm.FOURIER + 1)
        extra[-1, -1] = 1e-3
        return np.linalg.lstsq(np.vstack([z[rows], extra]), np.concatenate([y[rows], np.zeros(qm.FOURIER + 1)]), rcond=None)[0]

    assert np.allclose(model.weights, solved(learnt), atol=1e-6)
    by_other = {f: solved([i for i in learnt if fold[i] == qm.FOLDS[1 - k]]) for k, f in enumerate(qm.FOLDS)}
    width = (qm.RANGE[1] - qm.RANGE[0]) / qm.BINS
    bins = {}
    for i in learnt:
        b = int(np.clip((z[i] @ by_other[fold[i]] - qm.RANGE[0]) / width, 0, qm.BINS - 1))
        n, total = bins.get(b, (0, 0.0))
        bins[b] = n + 1, total + y[i]
    xs, ps = qm.isotonic([(qm.RANGE[0] + (b + 0.5) * width, n, t) for b, (n, t) in bins.items()])
    assert np.allclose(model.xs, xs) and np.allclose(model.ps, ps)
    raw = z @ solved(learnt)
    assert np.allclose(model.score(x), np.clip(0.99 * np.interp(raw, xs, ps) + 0.01 * np.clip((raw - qm.RANGE[0]) / (qm.RANGE[1] - qm.RANGE[0]), 0, 1), 0, 1), atol=1e-6)


def test_normal_equations_by_fold(spark):
    rng = np.random.default_rng(6)
    x, y, f = rng.normal(size=(200, len(qm.STATISTICS))), rng.integers(0, 2, 200).astype(float), rng.choice(qm.FOLDS, 200)
    rows = spark.createDataFrame([(*map(float, r), float(a), int(b)) for r, a, b in zip(x, y, f, strict=True)], ", ".join(f"{s} double" for s in qm.STATISTICS) + ", label double, fold int").repartition(6)
    fourier = qm.Fourier([0.0] * x.shape[1], [1.0] * x.shape[1])
    for fold, (gram, moment) in qm.normal_equations(rows, fourier).items():
        z = fourier(x[f == fold])
        assert np.allclose(gram, z.T @ z) and np.allclose(moment, z.T @ y[f == fold])
        assert np.allclose((gram + np.diag([qm.RIDGE] * qm.FOURIER + [1e-6])) @ qm.ridge(gram, moment), moment)
