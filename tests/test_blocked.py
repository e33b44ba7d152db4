"""Factors of matrices that are tables: shape, residual, and numpy's values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.operators import blocked
from skeinframe.operators.tensor import Tensor

RNG = np.random.default_rng(3)


def tensor(spark, a):
    return Tensor.host(spark, [None if x != x else float(x) for x in a.ravel(order="F")], a.shape)


def matrix(t):
    out = np.zeros(t.dims[:2])
    rows = t.df.toPandas()
    assert not rows.duplicated(["d0", "d1"]).any()
    out[rows.d0, rows.d1] = rows.v
    return out


def definite(n):
    b = RNG.normal(size=(n, n + 3))
    return b @ b.T + np.eye(n)


@pytest.mark.parametrize(("n", "tile"), [(1, 4), (8, 8), (13, 4)])
def test_factor_solution_and_inverse(spark, n, tile, monkeypatch):
    if n == 13:
        monkeypatch.setattr(blocked, "SENT", 0)  # panels joined by shuffles
    a, b = definite(n), RNG.normal(size=(n, 6))
    t = tensor(spark, a)
    low = matrix(blocked.cholesky(t, tile=tile))
    assert np.allclose(low, np.linalg.cholesky(a)) and not np.triu(low, 1).any() and (np.diag(low) > 0).all()
    assert np.allclose(matrix(blocked.cholesky(t, True, tile)), low.T)
    assert np.allclose(matrix(blocked.solve(t, tensor(spark, b), tile)), np.linalg.solve(a, b))
    assert np.allclose(matrix(blocked.inverse(t, tile)), np.linalg.inv(a))
    assert np.isclose(blocked.log_determinant(t, tile), np.linalg.slogdet(a)[1])


def test_the_upper_part_is_not_read(spark):
    a = definite(6)
    assert np.allclose(matrix(blocked.cholesky(tensor(spark, np.tril(a)), tile=4)), np.linalg.cholesky(a))


def test_what_has_no_factor(spark):
    a = definite(7)
    a[5, 5] = -1.0
    with pytest.raises(ValueError, match="order 6"):
        blocked.cholesky(tensor(spark, a), tile=4)
    a[1, 0] = np.nan
    with pytest.raises(ValueError, match="finite"):
        blocked.cholesky(tensor(spark, a), tile=4)
    with pytest.raises(ValueError, match="square"):
        blocked.cholesky(tensor(spark, a[:3]), tile=4)
    with pytest.raises(ValueError, match="match"):
        blocked.solve(tensor(spark, definite(3)), tensor(spark, np.ones((2, 1))))


def test_a_matrix_of_many_tiles(spark):
    """1,024 x 1,024, five panels: residual and shape."""
    n = 1024
    i, j = F.col("d0"), F.col("d1")
    t = Tensor.grid(spark, [n, n], F.exp(-F.abs(i - j) / 50.0) + F.when(i == j, 1.0 + i / n).otherwise(0.0))
    low = blocked.cholesky(t, tile=208)
    l, a = matrix(low), matrix(t)
    assert np.abs(l @ l.T - a).max() < 1e-10 and not np.triu(l, 1).any()
    x = matrix(blocked.solve(t, Tensor.grid(spark, [n, 2], F.sin(i + j)), 208))
    assert np.abs(a @ x - np.sin(np.arange(n)[:, None] + np.arange(2))).max() < 1e-9
