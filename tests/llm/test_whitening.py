"""Whitening against the eigenvectors of the covariance as a matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import queries, whitening


def by_force(vectors, k):
    x = np.array([[math.floor(64 * float(e)) + 1_000_000 for e in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    return values, (c @ u) / np.sqrt(values), [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], float(np.trace(c.T @ c / n))


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def test_query(spark, sf):
    got = queries.op11_embedding_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect())
    values, white, deviations, trace = by_force([v for _, v in rows], 32)
    assert got.vec_id.tolist() == [i for i, _ in rows for _ in range(32)] and got.component.tolist() == list(range(1, 33)) * len(rows)
    assert got.deviation.tolist() == [d for d in deviations for _ in range(32)] and set(got.n) == {len(rows)}
    own = got.whitened.to_numpy().reshape(-1, 32)
    own = own * np.sign((own * white).sum(axis=0))
    assert np.abs(own - white).max() < 1e-9
    assert np.abs(got.explained.to_numpy()[:32] / (values / trace) - 1).max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_a_falling_spectrum_needs_no_wide_block(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 60)) * (40 * 0.55 ** np.arange(60)) @ np.linalg.qr(rng.standard_normal((60, 60)))[0]
    rows = whitening.prepared(embeddings(spark, vectors), "vec_id", "embedding")
    model = whitening.fit(rows, 4, extra=4)
    values, white, _, _ = by_force(np.float32(vectors), 4)
    assert np.abs(model.eigenvalues / values - 1).max() < 1e-10 and 2 <= model.passes <= 12
    got = np.array([r.whitened for r in whitening.transform(rows, model).orderBy("key").collect()])
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-8
    assert whitening.identity_error(rows, model) < 1e-10


def test_equal_eigenvalues(spark):
    """Components of equal eigenvalues are not determined, but they are orthonormal and whiten."""
    vectors = np.vstack([np.eye(6) * 3, -np.eye(6) * 3])
    rows = whitening.prepared(embeddings(spark, vectors), "vec_id", "embedding")
    model = whitening.fit(rows, 4, extra=1)
    assert np.abs(model.components @ model.components.T - np.eye(4)).max() < 1e-12 and np.ptp(model.eigenvalues) < 1e-9 * model.eigenvalues[0]
    assert whitening.identity_error(rows, model) < 1e-10


def test_odd_vectors(spark):
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [2.0, -1.0], [1e30, 0.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    ids = [1, 2, None, 2, 3]
    df = spark.createDataFrame([(i, v) for i, v in zip(ids + [9] * len(bad), good + bad, strict=True)], "vec_id long, embedding array<double>").withColumn("key", F.lit("x")).withColumn("x", F.lit(1))
    rows = whitening.prepared(df, "vec_id", "embedding")
    assert sorted((r.key for r in rows.collect()), key=str) == sorted(ids, key=str)
    model = whitening.fit(rows)
    out = whitening.transform(rows, model).collect()
    assert len(out) == 5 and all(len(r.whitened) == len(model.eigenvalues) for r in out)
    assert model.n == 5 and model.sums[0] == sum(math.floor(64 * v[0]) for v in good[:4]) + whitening.LARGEST + 5_000_000


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    rows = whitening.prepared(embeddings(spark, vectors), "vec_id", "embedding")
    model = whitening.fit(rows)
    assert len(model.eigenvalues) == 0 and whitening.identity_error(rows, model) == 0.0
    assert [(r.deviation, r.whitened) for r in whitening.transform(rows, model).collect()] == [(0, [])] * len(vectors)


def test_exact_deviations():
    x = np.array([[(1 << 50) + 7, 1], [3, -(1 << 50)]], np.int64)
    s = np.array([int(v) for v in x.sum(axis=0)], object)
    assert whitening._deviations(x, 2, s) == [None, None]
    x = np.array([[1_000_005, 999_990], [1_000_001, 1_000_100]], np.int64)
    s = np.array([int(v) for v in x.sum(axis=0)], object)
    assert whitening._deviations(x, 2, s) == [16 + 110**2, 16 + 110**2]
