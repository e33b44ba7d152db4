"""Filters of a long series against the row-by-row formula."""

import math

import numpy as np
import pytest

from skeinframe.operators import long


def series(spark, x, parts=5):
    rng = np.random.default_rng(0)
    rows = [(i * 3 - 50, None if v is None else float(v), f"r{i}") for i, v in enumerate(x)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "i long, v double, tag string").repartition(parts)


def recursive(x, b, a):
    y = []
    for i in range(len(x)):
        s = sum(c * x[i - k] for k, c in enumerate(b) if i >= k) - sum(c * y[i - k] for k, c in enumerate(a) if k and i >= k)
        y.append(s / a[0])
    return y


@pytest.mark.parametrize(("b", "a"), [([0.2, 0.3, 0.1], [1.0, -1.2, 0.5]), ([1.0], [2.0, -1.0]), ([0.5, 0.5, 0.25, 0.1], [1.0]), ([1.0, 0.3], [1.0, -0.4, 0.1, 0.02])])
@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_iir(spark, b, a, block):
    x = np.random.default_rng(3).normal(size=3001)
    out = long.iir_long(series(spark, x), "v", b, a, ["i"], block=block).orderBy("i").collect()
    assert [r["tag"] for r in out] == [f"r{i}" for i in range(len(x))] and [r["v"] for r in out] == x.tolist()
    assert [r["iir"] for r in out] == pytest.approx(recursive(x.tolist(), b, a), rel=1e-9, abs=1e-11)


def test_iir_edges(spark):
    out = long.iir_long(series(spark, [1.0, None, 2.0]), "v", [1.0], [1.0, -0.5], ["i"], name="v").orderBy("i").collect()
    assert out[0]["v"] == 1.0 and math.isnan(out[1]["v"]) and math.isnan(out[2]["v"])
    assert long.iir_long(series(spark, [1.0]).where("false"), "v", [1.0], [1.0, -0.5], ["i"]).collect() == []
    with pytest.raises(ValueError):
        long.iir_long(series(spark, [1.0]), "v", [1.0], [0.0, 1.0], ["i"])


@pytest.mark.parametrize(("taps", "block"), [(1, 16), (5, 7), (5, None), (150, 160), (150, None), (801, 900)])
def test_kernels(spark, taps, block):
    rng = np.random.default_rng(taps)
    x, h = rng.normal(size=2000), rng.normal(size=taps)
    df = series(spark, x)
    full = np.convolve(x, h)
    got = [r["fir"] for r in long.fir_long(df, "v", h.tolist(), ["i"], block=block).orderBy("i").collect()]
    assert got == pytest.approx(full[:2000].tolist(), abs=1e-9)
    got = [r["conv"] for r in long.convolve_long(df, "v", h.tolist(), ["i"], block=block).orderBy("i").collect()]
    assert got == pytest.approx(full[taps // 2 : taps // 2 + 2000].tolist(), abs=1e-9)


def test_kernel_edges(spark):
    x = [1.0] * 300
    x[10], x[200] = None, math.inf
    out = [r["conv"] for r in long.convolve_long(series(spark, x), "v", [1.0] * 101, ["i"], block=101).orderBy("i").collect()]
    want = [sum(0.0 if v is None else v for v in x[max(0, i - 50) : i + 51]) for i in range(300)]
    assert out == pytest.approx(want)
    short = series(spark, [1.0, 2.0])
    assert [r["fir"] for r in long.fir_long(short, "v", [1.0] * 100, ["i"]).orderBy("i").collect()] == [1.0, 3.0]
    assert long.fir_long(short.where("false"), "v", [1.0], ["i"]).collect() == []
    text = long.convolve_long(series(spark, x), "v", [1.0] * 101, ["i"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in text
