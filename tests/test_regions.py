"""Regions over tiles: the same as over the whole matrix."""

import numpy as np
import pytest

from skeinframe.functions.kernels import image as I
from skeinframe.operators.regions import regions, union
from skeinframe.operators.tensor import Tensor

RNG = np.random.default_rng(11)


def matrix(t):
    rows = t.df.toPandas()
    assert len(rows) == t.elements
    out = np.empty(t.dims[:2])
    out[rows.d0, rows.d1] = rows.v
    return out


def spiral(n):
    """One region that winds through all tiles."""
    a, i, j, di, dj = np.zeros((n, n)), 0, 0, 0, 1
    a[0, 0] = 1
    for length in [n - 1, *np.repeat(np.arange(n - 1, 0, -2), 2).tolist()]:
        for _ in range(length):
            i, j = i + di, j + dj
            a[i, j] = 1
        di, dj = dj, -di
    return a


@pytest.mark.parametrize("connectivity", [4, 8])
def test_random_and_winding_regions(spark, connectivity):
    for a, tile in ((RNG.random((19, 26)) < 0.5, 5), (spiral(15), 4), (np.ones((6, 9)), 3), (np.zeros((4, 4)), 3)):
        t = Tensor.host(spark, a.astype(float).ravel(order="F").tolist(), a.shape)
        assert (matrix(regions(t, connectivity, tile)) == I.regions(a, connectivity)).all()


def test_null_is_off_and_batches_are_refused(spark):
    t = Tensor.host(spark, [1.0, None, float("nan"), 0.0], [1, 4])
    assert matrix(regions(t, tile=2)).tolist() == [[1, 0, 2, 0]]
    assert regions(Tensor(t.df.limit(0), (0, 4, 1, 1))).df.count() == 0
    with pytest.raises(ValueError):
        regions(t.tile(1, 1, 2))


def test_union_of_hard_graphs(spark):
    """A star whose centre is the largest name, a chain, and names apart from them."""
    star = [(99, i) for i in range(10, 40)]
    chain = [(i, i + 1) for i in range(200, 240)]
    got = dict(map(tuple, union(spark.createDataFrame([*star, *chain, (7, 7), (301, 300)], "a long, b long")).select("label", "root").collect()))
    assert got == {**{i: 10 for i in [99, *range(10, 40)]}, **{i: 200 for i in range(200, 241)}, 300: 300, 301: 300}
    assert union(spark.createDataFrame([], "a long, b long")).count() == 0
