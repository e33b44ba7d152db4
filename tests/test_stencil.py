"""Neighbourhoods by tiles: the same as over the whole matrix, at every size of tile."""

import numpy as np
import pytest

from skeinframe.functions.kernels import image as I
from skeinframe.functions.kernels import signal as S
from skeinframe.operators import stencil
from skeinframe.operators.tensor import Tensor
from tests.test_plans import plan

RNG = np.random.default_rng(5)


def tensor(spark, a):
    return Tensor.host(spark, [None if x != x else float(x) for x in a.ravel(order="F")], a.shape)


def matrix(t):
    out = np.full(t.dims[:2], np.nan)
    rows = t.df.toPandas()
    assert len(rows) == t.elements and not rows.duplicated(["d0", "d1", "d2", "d3"]).any()
    out[rows.d0, rows.d1] = rows.v
    return out


MASK = np.array([[0, 1, 0], [1, 1, 1], [0, 0, 1]])
KERNEL = RNG.normal(size=(3, 4))
CASES = {
    "convolve2": (lambda t, n: stencil.convolve2(t, KERNEL, n), lambda a: S.convolve(a, KERNEL)),
    "convolve2_sep": (lambda t, n: stencil.convolve2_sep(t, [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, -1.0], n), lambda a: S.convolve_sep(a, np.arange(1.0, 6), np.array([1.0, -1.0]))),
    "medfilt2": (lambda t, n: stencil.medfilt2(t, (3, 5), "zero", n), lambda a: S.medfilt(a, (3, 5))),
    "medfilt2_symmetric": (lambda t, n: stencil.medfilt2(t, (3, 3), "symmetric", n), lambda a: S.medfilt(a, (3, 3), "symmetric")),
    "dilate": (lambda t, n: stencil.dilate(t, MASK, tile=n), lambda a: I.dilate(a, MASK)),
    "erode": (lambda t, n: stencil.erode(t, MASK, tile=n), lambda a: I.erode(a, MASK)),
    "minfilt": (lambda t, n: stencil.minfilt(t, 5, n), lambda a: I.minfilt(a, 5)),
    "maxfilt": (lambda t, n: stencil.maxfilt(t, 3, n), lambda a: I.maxfilt(a, 3)),
    "bilateral": (lambda t, n: stencil.bilateral(t, 2.0, 0.7, n), lambda a: I.bilateral(a, 2.0, 0.7)),
    "sobel_x": (lambda t, n: stencil.sobel(t, n)[0], lambda a: I.sobel(a)[0]),
    "sobel_y": (lambda t, n: stencil.sobel(t, n)[1], lambda a: I.sobel(a)[1]),
}


@pytest.mark.parametrize("name", CASES)
def test_tiles_give_what_the_whole_matrix_gives(spark, name):
    tiled, whole = CASES[name]
    for shape, tile in (((17, 23), 4), ((9, 8), 8), ((5, 31), 6)):
        a = RNG.normal(size=shape)
        assert np.allclose(matrix(tiled(tensor(spark, a), tile)), whole(a)), (shape, tile)


def test_edges(spark):
    one = tensor(spark, np.array([[3.0]]))
    assert matrix(stencil.convolve2(one, np.ones((3, 3)), 4)).tolist() == [[3.0]]
    a = RNG.normal(size=(7, 9))
    a[2, 3] = np.nan
    got = matrix(stencil.convolve2(tensor(spark, a), np.ones((3, 3)), 3))
    assert np.isnan(got[1:4, 2:5]).all() and np.isnan(got).sum() == 9
    assert stencil.convolve2(Tensor(one.df.limit(0), (0, 4, 1, 1)), np.ones((3, 3))).df.count() == 0
    with pytest.raises(ValueError):
        stencil.convolve2(one, np.ones((99, 3)), 8)


def test_matrices_of_a_batch_stay_apart(spark):
    a = RNG.normal(size=(6, 7, 2, 2))
    t = Tensor.host(spark, a.ravel(order="F").tolist(), a.shape)
    rows = stencil.dilate(t, MASK, tile=4).df.toPandas()
    out = np.empty(a.shape)
    out[rows.d0, rows.d1, rows.d2, rows.d3] = rows.v
    for i in range(2):
        for j in range(2):
            assert np.allclose(out[:, :, i, j], I.dilate(a[:, :, i, j], MASK))


def test_one_shuffle_and_no_join(spark):
    text = plan(stencil.convolve2(Tensor.grid(spark, [1000, 2000]), np.ones((3, 3))).df)
    assert text.count("Exchange hashpartitioning") <= 1 and "Join" not in text and "SinglePartition" not in text
