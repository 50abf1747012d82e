"""Factorisations of tall matrices and quantiles of whole columns, which stay distributed."""

import math

import numpy as np
import pytest

from tessera.operators import geometry, matrix, ordered
from tessera.operators.matrix import Array


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(matrix, "TALL_ROWS", 16)
    monkeypatch.setattr(matrix, "TALL_FAN", 3)


@pytest.mark.parametrize("rank", [4, 2])
def test_tall_qr_and_svd(spark, small_blocks, rank):
    """Also of a matrix without full rank, and with singular values far apart."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((203, rank)) @ rng.standard_normal((rank, 4)) * np.array([1, 1e-3, 1, 1e-9])
    x = Array(a)
    q, r = (m.to_numpy() for m in x.qr())
    assert np.allclose(q @ r, a, atol=1e-12) and np.allclose(r, np.triu(r))
    u, s, vt = x.svd()
    assert np.allclose(u.to_numpy() * s.to_numpy() @ vt.to_numpy(), a, atol=1e-12) and np.allclose(s.to_numpy(), np.linalg.svd(a, compute_uv=False), rtol=1e-6, atol=1e-15)
    if rank == 4:
        assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(u.to_numpy().T @ u.to_numpy(), np.eye(4))
    b = Array(a * np.array([1, 1e3, 1, 1e9]))
    assert b.rank() == rank and np.allclose(b.pseudo_inv().to_numpy(), np.linalg.pinv(b.to_numpy(), rcond=1e-10))


def test_rows_are_correlated_by_blocks_of_columns(spark):
    a = np.random.default_rng(2).standard_normal((5, 9001))
    assert np.allclose(Array(a).correlation_matrix().to_numpy(), np.corrcoef(a))


def test_quantiles(spark):
    x = [3.0, None, 1.0, 7.0, 7.0, -2.0, 5.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    clean = [v for v in x if v is not None]
    got = ordered.quantiles(df, "x", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert np.allclose(list(got), np.quantile(clean, [0, 0.37, 0.5, 1]))
    assert list(ordered.quantiles(df.limit(0), "x", {"a": 0.5}).first()) == [None]
    assert ordered.quantiles(spark.createDataFrame([(math.inf,), (-math.inf,)], "x double"), "x", {"a": 1.0}).first().a == math.inf


def test_nearest_keeps_few_rows_before_the_shuffle(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((300, 3)), rng.standard_normal((7, 3))
    table = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    found = geometry.nearest(table(a), table(b), 4)
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    want = {(j, k): int(i) for j in range(7) for k, i in enumerate(np.lexsort((np.arange(300), d[:, j]))[:4])}
    assert {(r.j, r["rank"]): r.i for r in found.collect()} == want
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("dtype", ["float32", "float16"])
def test_dtypes(spark, dtype):
    x = [0.1, -1 / 3, 65519.0, 65520.0, 1e-7, 3e-8, 2.9e-8, 0.0, 1e-40, 2049.0, 2051.0, math.inf]
    with np.errstate(over="ignore"):
        want = np.array([x]).astype(dtype).astype(float)
        assert (Array([x]).astype(dtype).to_numpy() == want).all() and (Array([x], dtype=dtype).to_numpy() == want).all()
