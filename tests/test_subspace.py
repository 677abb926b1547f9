"""Components by random subspaces against the exact decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from pairtide.functions import subspace


def table(rows, columns, seed=1):
    """Vectors with a falling spectrum and a mean far from zero."""
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(rows, 12)))[0], np.linalg.qr(rng.normal(size=(columns, 12)))[0]
    return u * (100 * 0.6 ** np.arange(12)) @ v.T + rng.normal(size=(rows, columns)) * 1e-3 + 50


def same_space(a, b):
    """The cosines of the angles between two orthonormal bases' spaces are all one."""
    return np.allclose(np.linalg.svd(a.T @ b)[1], 1, atol=1e-6)


@pytest.mark.parametrize(("rows", "columns"), [(300, 40), (400, 200), (60, 2000)])
def test_space_equals_the_exact_one(spark, rows, columns):
    x = table(rows, columns)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "i int, v array<double>").repartition(5)
    got = subspace.components(df, "v", 5, oversample=10)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(got.values, s[:5], rtol=1e-7) and same_space(got.vectors, v[:5].T) and np.allclose(got.mean, x.mean(axis=0))
    assert np.allclose(got.vectors.T @ got.vectors, np.eye(5)) and (got.vectors.max(axis=0) >= -got.vectors.min(axis=0)).all()
    again = subspace.components(df.repartition(2), "v", 5, oversample=10)
    assert np.allclose(again.vectors, got.vectors, atol=1e-6)
    low = {r.i: r.v for r in subspace.projected(df, "v", got).collect()}
    assert np.allclose([low[i] for i in range(rows)], (x - x.mean(axis=0)) @ got.vectors)


def test_twenty_thousand_columns(spark):
    x = table(40, 20_000)
    df = spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>").repartition(3)
    got = subspace.components(df, "v", 3, oversample=5)
    assert same_space(got.vectors, np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3].T)


def test_awkward_vectors(spark):
    x = table(30, 14)
    clean = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "i int, v array<double>")
    holes = spark.createDataFrame([(100, None), (101, [float("nan")] + [0.0] * 13)], "i int, v array<double>")
    want, got = subspace.components(clean, "v", 9), subspace.components(clean.unionByName(holes), "v", 9)
    assert got.vectors.shape == (14, 9) and np.allclose(np.abs(got.vectors), np.abs(want.vectors))
    low = {r.i: r.v for r in subspace.projected(clean.unionByName(holes), "v", got).collect()}
    assert low[100] is None and low[101] is None and len(low) == 32
    empty = subspace.components(clean.limit(0), "v", 3)
    assert empty.vectors.shape == (0, 0)
    with pytest.raises(Exception, match="entries"):
        subspace.components(clean.unionByName(spark.createDataFrame([(7, [1.0])], "i int, v array<double>")).coalesce(1), "v", 2)
