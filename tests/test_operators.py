import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.operators import neighbours, order, reduce, scan, series, stats
from skeinframe.operators.tensor import Tensor, chain_matmul, sparse_from_csr, to_csr

NAN = float("nan")


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), names)


def test_by_key_runs(spark):
    df = frame(spark, pos=list(range(9)), k=[0, 0, 1, 1, 1, 0, 0, 2, 2], v=[float(x) for x in range(1, 10)])
    out = reduce.reduce_by_key(df, "k", "v", ["pos"], ["sum", "product", "min", "max", "count"]).orderBy("run").collect()
    assert [r["k"] for r in out] == [0, 1, 0, 2] and [r["sum"] for r in out] == [3, 12, 13, 17]
    assert [r["product"] for r in out] == [2, 60, 42, 72] and [r["max"] for r in out] == [2, 5, 7, 9]


def test_nan_rules(spark):
    df = frame(spark, i=[0, 1, 2, 3], v=[1.0, NAN, -2.0, 5.0])
    r = reduce.reduce(df, "v", ["sum", "product", "min", "max", "count"]).first()
    assert math.isnan(r["sum"]) and math.isnan(r["product"]) and (r["min"], r["max"], r["count"]) == (-2.0, 5.0, 4)
    r = reduce.reduce(df, "v", ["sum", "product"], nanval=2.0).first()
    assert (r["sum"], r["product"]) == (6.0, -20.0)
    r = reduce.reduce(df.where("i = 1"), "v", ["min", "max"]).first()
    assert (r["min"], r["max"]) == (math.inf, -math.inf)


def test_arg_ties(spark):
    df = frame(spark, i=[0, 1, 2, 3, 4], v=[3.0, 1.0, 3.0, 1.0, NAN])
    assert reduce.arg_reduce(df, "v", "i", "min").first()[:] == (1.0, 3)
    assert reduce.arg_reduce(df, "v", "i", "max").first()[:] == (3.0, 0)


def test_scans(spark):
    df = frame(spark, i=list(range(6)), k=[1, 1, 0, 0, 1, 1], v=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    col = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    assert col(scan.scan(df, "v", ["i"], "mul", False), "scan") == [1, 1, 2, 6, 24, 120]
    assert col(scan.scan_by_key(df, "k", "v", ["i"]), "scan") == [1, 3, 3, 7, 5, 11]
    for op, f in (("add", np.add), ("max", np.maximum)):
        assert col(scan.long_scan(df, "v", "i", op, block=2), "scan") == f.accumulate([1, 2, 3, 4, 5, 6]).tolist()
    assert col(scan.long_scan(df, "v", "i", "add", False, 2), "scan") == [0, 1, 3, 6, 10, 15]
    assert col(scan.diff2(df.withColumn("v", F.col("v") * F.col("v")), "v", ["i"]), "diff") == [2, 2, 2, 2]


def test_topk_and_sort_are_stable(spark):
    df = frame(spark, i=list(range(6)), v=[2.0, 5.0, 2.0, 5.0, 1.0, 5.0])
    assert [(r["value"], r["index"]) for r in order.topk(df, "v", "i", 4).orderBy("rank").collect()] == [(5, 1), (5, 3), (5, 5), (2, 0)]
    assert [r["index"] for r in order.sort_index(df, "v", "i").orderBy("rank").collect()] == [4, 0, 2, 1, 3, 5]


def test_histogram_clamps(spark):
    df = frame(spark, v=[-5.0, 0.0, 0.9, 5.0, 9.99, 10.0, 77.0, NAN])
    assert [r["count"] for r in stats.histogram(df, "v", 5, 0.0, 10.0).orderBy("bin").collect()] == [3, 0, 1, 0, 3]


def test_weighted_variance(spark):
    rng = np.random.default_rng(0)
    v, w = rng.normal(1e6, 1, 200), rng.random(200)
    r = stats.var_weighted(frame(spark, v=v.tolist(), w=w.tolist()), "v", "w").first()
    mean = (w * v).sum() / w.sum()
    assert (r["mean"], r["var"]) == pytest.approx((mean, (w * (v - mean) ** 2).sum() / w.sum()))


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).integers(-9, 9, (4, 3, 2)).astype(float)


def tensor(spark, a):
    return Tensor.host(spark, a.ravel(order="F").tolist(), a.shape)


def array(t):
    shape = t.dims
    while len(shape) > 1 and shape[-1] == 1:
        shape = shape[:-1]
    return np.array(t.values(), float).reshape(shape, order="F")


def test_tensor_shapes(spark, cube):
    t = tensor(spark, cube)
    same = lambda x, y: np.testing.assert_array_equal(np.squeeze(array(x)), np.squeeze(y))
    same(t.moddims(6, 4), cube.reshape(6, 4, order="F"))
    same(t.reorder(2, 0, 1), cube.transpose(2, 0, 1))
    same(t.shift(1, -1), np.roll(cube, (1, -1), (0, 1)))
    same(t.flip(0), cube[::-1])
    same(t.tile(2, 1, 2), np.tile(cube, (2, 1, 2)))
    same(t.join(1, t), np.concatenate([cube, cube], axis=1))
    same(t[1:3, ::2], cube[1:3, ::2])
    same(t[::-1, 1], cube[::-1, 1:2])
    same(t[[0, 5, -1]], cube[[0, 2, 0]])
    for border, mode in (("zero", "constant"), ("clamp", "edge"), ("periodic", "wrap"), ("symmetric", "symmetric")):
        same(t.pad([2, 1], [3, 2], border), np.pad(cube, [(2, 3), (1, 2), (0, 0)], mode=mode))
    patched = cube.copy()
    patched[1:3, [0, 2]] = 7.0
    same(t.assign((slice(1, 3), [0, 2]), 7.0), patched)
    same(t.reduce("sum", 1), cube.sum(axis=1, keepdims=True))
    same(t.scan("max", 0), np.maximum.accumulate(cube, axis=0))
    same(t.sort(0), np.sort(cube, axis=0))
    same(t - t.reduce("max", 0), cube - cube.max(axis=0))
    same((t > 0).where().map(lambda v: v.cast("double")), np.flatnonzero((cube > 0).ravel(order="F")))
    assert t.reduce("sum", 3) is t and t.ndims == 3 and t.bytes() == 24 * 8 and not t.is_vector() and t.is_double()


def test_matrices(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.random((3, 4)), rng.random((4, 5)), rng.random((5, 2))
    ta, tb, tc = (tensor(spark, x) for x in (a, b, c))
    np.testing.assert_allclose(array(ta.matmul(tb)), a @ b)
    np.testing.assert_allclose(array(chain_matmul(ta, tb, tc)), a @ b @ c)
    np.testing.assert_allclose(array(tb.matmul(ta, trans_a=True, trans_b=True)), b.T @ a.T)
    batch = rng.random((3, 4, 2))
    np.testing.assert_allclose(array(tensor(spark, batch).matmul(tb)), np.einsum("ijk,jl->ilk", batch, b))
    z = Tensor.host(spark, [(1.0, 2.0), (0.0, -1.0)], [2], "c64")
    assert tuple(z.dot(z, (True, False)).scalar()) == (6.0, 0.0)


def test_sparse(spark):
    t = sparse_from_csr(spark, 3, 4, [1.0, 2.0, 3.0], [0, 2, 2, 3], [1, 3, 0])
    assert array(t).tolist() == [[0, 1, 0, 2], [0, 0, 0, 0], [3, 0, 0, 0]] and t.nnz() == 3
    pointers, entries = to_csr(t)
    assert [r["ptr"] for r in pointers.orderBy("row").collect()] == [0, 2, 2, 3]
    assert [(r["col"], r["v"]) for r in entries.orderBy("n").collect()] == [(1, 1.0), (3, 2.0), (0, 3.0)]
    x = Tensor.host(spark, [1.0, 1.0, 1.0, 1.0])
    assert array(t.matmul(x)).tolist() == [3, 0, 3]


def test_nearest_blocks(spark):
    rng = np.random.default_rng(3)
    q, t = rng.integers(0, 200, (30, 6)), rng.integers(0, 200, (80, 6))
    dq = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "id long, v array<double>")
    dt = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(t)], "id long, v array<double>").repartition(3)
    old = neighbours.BLOCK
    for metric, block in (("sad", old), ("ssd", 7), ("shd", old)):
        neighbours.BLOCK = block
        out = {}
        for r in neighbours.nearest_neighbours(dq, dt, 3, metric).collect():
            out[r["query_id"], r["rank"]] = (r["distance"], r["train_id"])
        neighbours.BLOCK = old
        d = neighbours.distances(q.astype(float), t.astype(float), metric)
        for i in range(30):
            assert [out[i, k] for k in range(3)] == sorted(zip(d[i], range(80)))[:3]


def test_series(spark):
    x = np.random.default_rng(4).random(20)
    df = frame(spark, lane=[0] * 20, i=list(range(20)), v=x.tolist())
    col = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    np.testing.assert_allclose(col(series.fir(df, "v", [1.0, 0.5, -0.2], ["i"], ["lane"]), "fir"), np.convolve(x, [1, 0.5, -0.2])[:20])
    np.testing.assert_allclose(col(series.convolve1(df, "v", [1.0, 2.0, 3.0], ["i"], ["lane"]), "conv"), np.convolve(x, [1, 2, 3])[1:21])
    np.testing.assert_allclose(col(series.gradient(df, "v", ["i"], ["lane"]), "gradient"), np.gradient(x))
    row = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(series.iir(F.col("x"), [0.3, 0.1], [1.0, -0.4, 0.2]).alias("y")).first()["y"]
    y = np.zeros(20)
    for i in range(20):
        y[i] = 0.3 * x[i] + 0.1 * (x[i - 1] if i else 0) + 0.4 * (y[i - 1] if i else 0) - 0.2 * (y[i - 2] if i > 1 else 0)
    np.testing.assert_allclose(row, y)


def test_blocks_give_what_one_window_gives(spark):
    """Scans, runs and places without lanes go in blocks of a whole number; negative positions, NULLs and gaps among them."""
    rows = [(i * 300_001 - 900_000, None if i % 5 == 0 else float(i), "ab"[i // 3 % 2] if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, v double, k string")
    lane = df.withColumn("l", F.lit(0))
    for op in ("add", "mul", "min", "max"):
        for inclusive in (True, False):
            a = [r["scan"] for r in scan.scan(df, "v", ["i"], op, inclusive).orderBy("i").collect()]
            b = [r["scan"] for r in scan.scan(lane, "v", ["i"], op, inclusive, ["l"]).orderBy("i").collect()]
            assert a == pytest.approx(b)
    a = reduce.runs(df, "k", ["i"]).orderBy("i").collect()
    b = reduce.runs(lane, "k", ["i"], ["l"]).orderBy("i").collect()
    assert [r["run"] for r in a] == [r["run"] for r in b]
    t = Tensor.grid(spark, [3 << 20], F.when(F.col("i") % 500_000 == 1, 1.0).otherwise(0.0)).where()
    assert [r["v"] for r in t.df.orderBy("d0").collect()] == [1 + 500_000 * i for i in range(7)] and t.dims[0] == 7


def test_products_by_tiles_and_by_joins_agree(spark, monkeypatch):
    made = lambda dims, seed: Tensor.grid(spark, dims, F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1000)) / 1000.0)
    for x, y in (([3, 5], [5, 2]), ([260, 30], [30, 5]), ([2, 5000], [5000, 2]), ([3, 4, 2], [4, 5, 1]), ([3, 4, 1, 2], [4, 5, 3, 1])):
        a, b = made(x, 1), made(y, 2)
        monkeypatch.setattr("skeinframe.operators.tensor.JOINED_PRODUCTS", 1 << 40)
        joined = {tuple(r)[:4]: r["v"] for r in a.matmul(b).df.collect()}
        monkeypatch.setattr("skeinframe.operators.tensor.JOINED_PRODUCTS", 0)
        tiled = {tuple(r)[:4]: r["v"] for r in a.matmul(b).df.collect()}
        assert tiled == pytest.approx(joined)
