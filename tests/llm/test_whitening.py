"""Whitening against a dense eigendecomposition, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.llm import whitening
from chirplake.llm.whitening import Rows, Whitener, bidiagonal, blocks, fit, whitened


def frame(spark, vectors, parts=3, kind="float"):
    df = spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")
    return df.withColumn("component", F.lit("mine")).repartition(parts)


def dense(x):
    """Variances by falling value, components as columns, and the exact deviations."""
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    return values[::-1], vectors[:, ::-1], [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]


def compare(df, vectors, components=8):
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    values, parts, deviations = dense(x)
    model = fit(df, vector="embedding", components=components)
    out = whitened(df, model, vector="embedding", carry=["vec_id", "component"]).collect()
    k = len(model.variances)
    assert len(out) == len(x) * k and {r.n for r in out} == {len(x)} and model.identity_error < 1e-9
    expected = (x - x.sum(0) / len(x)) @ parts[:, :k] / np.sqrt(values[:k])
    found = np.zeros((len(x), k))
    for r in out:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviations[r.vec_id]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    return found * np.sign((found * expected).sum(0)), expected


@pytest.mark.parametrize("n, dim", [(300, 12), (40, 3), (9, 20)])
def test_equals_dense(spark, n, dim):
    random = np.random.default_rng(n)
    vectors = random.standard_normal((n, dim)) * np.linspace(1, 3, dim)
    found, expected = compare(frame(spark, vectors), vectors)
    assert found.shape[1] == min(8, dim, n - 1) and np.abs(found - expected).max() < 1e-9


def test_lost_rank_and_repeats(spark):
    """Dependent dimensions, a constant one, and rows repeated many times."""
    random = np.random.default_rng(1)
    vectors = np.round(random.standard_normal((50, 4)), 2)
    vectors = np.column_stack([vectors, np.ones(50), vectors[:, 0]])
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 100, 0)])
    found, expected = compare(frame(spark, vectors), vectors)
    assert found.shape[1] == 4 and np.abs(found - expected).max() < 1e-9


def test_equal_variances(spark):
    """A space of equal eigenvalues is found whole: the search starts again where it closes."""
    vectors = [s * np.eye(6)[k] * 2 for k in range(6) for s in (1, -1)]
    df = frame(spark, vectors)
    rows = Rows(blocks(df, "embedding", 6), 6)
    right, values = bidiagonal(rows, 6)
    assert np.allclose(values, values[0]) and np.allclose(right.T @ right, np.eye(6), atol=1e-12)


def test_converges_before_the_end(spark, monkeypatch):
    """Beyond FULL dimensions the steps end when the components have converged."""
    monkeypatch.setattr(whitening, "FULL", 4)
    random = np.random.default_rng(2)
    vectors = random.standard_normal((400, 40)) * np.concatenate([[60, 40, 25], np.full(37, 0.5)])
    calls = []
    summed = Rows.summed
    monkeypatch.setattr(Rows, "summed", lambda self, work: calls.append(1) or summed(self, work))
    found, expected = compare(frame(spark, vectors), vectors, components=3)
    assert len(calls) < 30 and np.abs(found - expected).max() < 1e-7


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_PARTS", 1)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 7)
    vectors = np.random.default_rng(3).standard_normal((60, 5))
    found, expected = compare(frame(spark, vectors), vectors)
    assert np.abs(found - expected).max() < 1e-9


def test_edges(spark):
    fine = [[1.0, 2.0], [3.0, 1.0], [2.0, 5.0], [2.0, 5.0]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    for kind in ("float", "double"):
        df = frame(spark, fine + odd, kind=kind)
        model = fit(df, vector="embedding")
        out = whitened(df, model, vector="embedding", carry=["vec_id", "component"]).collect()
        assert sorted({r.vec_id for r in out}) == [0, 1, 2, 3] and len(out) == 8 and model.n == 4
        assert sorted(r.whitened for r in out if r.vec_id == 2) == sorted(r.whitened for r in out if r.vec_id == 3)
    for rows in ([], odd[:2], [fine[0]] * 3):
        df = frame(spark, rows)
        assert whitened(df, fit(df, vector="embedding"), vector="embedding", carry=["vec_id"]).count() == 0


def test_deviations_beyond_long():
    model = Whitener(10**9, [10**9 * 100_000], np.eye(1), np.ones(1), 1.0, 0.0)
    assert model.deviations(np.array([[100_001], [100_003], [100_004], [10**9]])) == [10**18, 9 * 10**18, None, None]
