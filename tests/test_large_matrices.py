"""Transforms and factorizations of tables against numpy."""

import numpy as np
import pytest

from skeinframe.operators import fourier, tall


def lanes(spark, x, parts=6):
    """Complex lanes by rows as (lane, i, re, im), in no order."""
    cells = [(int(k), int(i), float(v.real), float(v.imag)) for (k, i), v in np.ndenumerate(x)]
    order = np.random.default_rng(0).permutation(len(cells))
    return spark.createDataFrame([cells[j] for j in order], "lane long, i long, re double, im double").repartition(parts)


def back(df, shape):
    out = np.full(shape, np.nan, complex)
    for k, i, re, im in df.collect():
        out[k, i] = re + 1j * im
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 64, 77, 360, 1001])
def test_fft_of_lanes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(3, n)) + 1j * rng.normal(size=(3, n))
    df = lanes(spark, x)
    assert np.allclose(back(fourier.fft_long(df, n), x.shape), np.fft.fft(x), atol=1e-10)
    assert np.allclose(back(fourier.fft_long(df, n, True), x.shape), np.fft.ifft(x), atol=1e-10)
    assert np.allclose(back(fourier.fft_long(df, n, im=None), x.shape), np.fft.fft(x.real), atol=1e-10)


def test_large_prime_factors_go_by_chirps(spark, monkeypatch):
    monkeypatch.setattr(fourier, "LONGEST", 100)
    x = np.random.default_rng(1).normal(size=(2, 211)) + 0j
    assert np.allclose(back(fourier.fft_long(lanes(spark, x), 211), x.shape), np.fft.fft(x), atol=1e-9)


def test_fft2_and_missing_elements(spark):
    x = np.random.default_rng(2).normal(size=(12, 35)) + 0j
    df = lanes(spark, x).withColumnsRenamed({"lane": "d0", "i": "d1"})
    assert np.allclose(back(fourier.fft2_long(df, [12, 35]), x.shape), np.fft.fft2(x), atol=1e-9)
    assert np.allclose(back(fourier.fft2_long(fourier.fft2_long(df, [12, 35]), [12, 35], True), x.shape), x, atol=1e-9)
    with pytest.raises(Exception, match="misses elements"):
        fourier.fft_long(lanes(spark, x).where("i <> 3"), 35).collect()


def vectors(spark, x, parts=40):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def columns(df, name):
    return np.array([r[0] for r in df.orderBy("id").select(name).collect()])


def test_qr_and_singular_values(spark, monkeypatch):
    monkeypatch.setattr(tall, "FAN", 4)
    monkeypatch.setattr(tall, "ROWS", 16)
    x = np.random.default_rng(3).normal(size=(900, 9)) @ np.diag(10.0 ** -np.arange(9))  # condition 1e8
    df = vectors(spark, x)
    q, r = tall.qr(df, "v", 9)
    q = columns(q, "q")
    assert np.allclose(q.T @ q, np.eye(9), atol=1e-12) and (np.tril(r, -1) == 0).all() and (np.diag(r) > 0).all() and np.allclose(q @ r, x, atol=1e-14)
    assert tall.singular_values(df, "v", 9) == pytest.approx(np.linalg.svd(x, compute_uv=False), rel=1e-7)
    u, s, vt = tall.svd(df, "v", 9)
    u = columns(u, "u")
    assert np.allclose((u * s) @ vt, x, atol=1e-12) and np.allclose(vt @ vt.T, np.eye(9))
    assert tall.solve(df.withColumn("y", __import__("pyspark").sql.functions.col("v")[0] * 3), "v", 9, "y") == pytest.approx([3.0] + [0.0] * 8, abs=1e-6)


def test_dependent_columns_and_few_rows(spark):
    x = np.random.default_rng(4).normal(size=(200, 3))
    x = np.hstack([x, x[:, :1] + x[:, 1:2]])
    df = vectors(spark, x)
    assert tall.rank(df, "v", 4) == 3 and len(tall.svd(df, "v", 4)[1]) == 3
    p = columns(tall.pinverse(df, "v", 4), "p").T
    assert np.allclose(p, np.linalg.pinv(x), atol=1e-10)
    with pytest.raises(ValueError):
        tall.qr(df, "v", 4)
    assert np.allclose(np.abs(tall.factor(df.where("id < 2"), "v", 4)), np.abs(np.vstack([np.linalg.qr(x[:2], mode="r"), np.zeros((2, 4))])))
    assert (tall.factor(df.where("false"), "v", 4) == 0).all()
    with pytest.raises(Exception, match="components"):
        tall.factor(df, "v", 5)
