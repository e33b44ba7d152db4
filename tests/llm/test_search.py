import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.llm import search


def brute(rows, k=10):
    """rows: (id, vector). Query ids divisible by 100, every other row a candidate."""
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is not None and q % 100 == 0:
            found = [(-sum(s * t for s, t in zip(x, y)), c is None, c or 0) for b, (c, y) in enumerate(ok) if a != b and len(x) == len(y)]
            out += [(q, n + 1, None if none else c, -s) for n, (s, none, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def clusters(rng, n, centres=40, dims=16):
    c = rng.normal(size=(centres, dims))
    return [(c[rng.integers(centres)] + rng.normal(size=dims) * 0.05).tolist() for _ in range(n)]


@pytest.fixture()
def small(monkeypatch):
    for name, value in {"SHARD": 96, "BLOCK": 8, "DEALT": 5, "TOGETHER": 3}.items():
        monkeypatch.setattr(search, name, value)


def test_against_brute_force(spark, small):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(clusters(rng, 900))]
    rows += [(100, rows[3][1]), (100, rows[100][1]), (None, rows[200][1]), (1001, None), (1002, [None] * 16), (1003, [math.nan] * 16), (1004, [math.inf] + [0.0] * 15), (1100, [0.0] * 16), (1200, []), (1201, []), (1202, [1.0] * 3), (1300, [2.0, -1.0, 0.5]), (1400, [1.0, 2.0])]
    rows += [(2000 + i, rows[300][1]) for i in range(300)]  # copies of a query, ties
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(6)
    assert sorted((tuple(r) for r in search.top_k(df).collect()), key=str) == brute(rows)


def test_columns_and_other_queries(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    got = search.top_k(df, F.col("id") == 7, 3)
    assert [(c, t) for c, t in got.dtypes] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [(7, 1, 29), (7, 2, 28), (7, 3, 27)]
    assert search.top_k(df.where("false")).collect() == [] and search.top_k(df.where("vec_id = 0")).collect() == []


def test_large_numbers(spark):
    rows = [(0, [1e12, -3.5e11]), (1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [123456789.125, 987654321.5]), (4, [1e300, 0.0]), (5, [3e5, 7e5]), (100, [3e6 + 1 / 1024, 5.0])]
    got = {(r[0], r[2]): r[3] for r in search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = lambda v: [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in v]
    for q in (0, 100):
        for i, v in rows:
            if i != q:
                s = sum(a * b for a, b in zip(whole(dict(rows)[q]), whole(v)))
                assert got[q, i] == min(max(s, -(1 << 63)), (1 << 63) - 1)


def test_bounds_hold_and_most_blocks_are_left_out(small):
    rng = np.random.default_rng(2)
    x = np.floor(1024 * np.array(sorted(clusters(rng, 4000), key=lambda v: v[0] > 0))).astype(np.int64)
    # in order of the nearest of a few of them, as the index has it
    p = x[:40].astype(float)
    x = x[np.argsort(((p * p).sum(1) - 2 * x @ p.T).argmin(1), kind="stable")]
    cut = [x[i : i + 8] for i in range(0, len(x), 8)]
    shard = search.Shard(16, [{"data": search._packed(c.ravel()), "lows": search._packed(c.min(0)), "highs": search._packed(c.max(0)), "ids": list(range(8 * n, 8 * n + 8)), "places": list(range(8 * n, 8 * n + 8))} for n, c in enumerate(cut)])
    scored = 0
    for q in range(0, 4000, 100):
        b = search.bounds(x[q : q + 1], shard.lows, shard.highs)[0]
        true = np.array([(c @ x[q]).max() for c in cut])
        assert (b >= true).all()
        rows, found, done = shard.best(x[q], q, b, -np.inf, 10)
        want = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:10]
        assert [(-int(s), int(r)) for s, r in zip(found, rows)] == want
        scored += done
    assert scored < 0.3 * 40 * len(cut)
