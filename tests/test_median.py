"""Medians by counts against the sorted values, whatever the groups' sizes and values."""

import math

import numpy as np
import pytest

from skeinframe.operators import stats


def middle(values):
    v = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
    return None if not v else v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2 - 1] + v[len(v) // 2]) / 2


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (a == b or a != a and b != b or a == pytest.approx(b, rel=1e-12))


@pytest.mark.parametrize("few", [3, 50, 1 << 16])
def test_groups(spark, few):
    rng = np.random.default_rng(few)
    groups = {
        "hot": rng.normal(size=5001).tolist(), "even": rng.normal(size=400).tolist(), "two": [0.0] * 300 + [1.0] * 300, "one": [7.5] * 700, None: rng.integers(0, 5, 901).astype(float).tolist(),
        "wide": (10.0 ** rng.uniform(-300, 300, 800)).tolist() + [-1e300, -math.inf, math.inf], "nan": [math.nan] * 400 + [1.0, 2.0], "some": [None, 3.0, None], "none": [None, None], "tail": [0.0] * 10 + (1e6 + rng.normal(size=3000)).tolist() + [-0.0],
    }
    rows = [(k, x) for k, v in groups.items() for x in v]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, v double").repartition(7)
    got = {r["k"]: r["median"] for r in stats.median_of(df, "v", ["k"], few).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert same(got[k], middle(v)), (k, got[k], middle(v))


@pytest.mark.parametrize("few", [10, 1 << 16])
def test_all_rows(spark, few):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 100_000, 4000).astype(float).tolist()
    df = spark.createDataFrame([(x,) for x in [*v, None]], "v double").repartition(5)
    assert [r[0] for r in stats.median_of(df, "v", few=few).collect()] == [middle(v)]
    assert [r[0] for r in stats.median_of(df.where("v is null"), "v", few=few).collect()] == [None]
    assert stats.median_of(df.where("false"), "v", few=few).count() == 1
