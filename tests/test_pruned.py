"""Pruned neighbours: the rows of the plain form, with far fewer distances taken."""

import math

import numpy as np
import pytest

from skeinframe.operators import pruned
from skeinframe.operators.neighbours import nearest_neighbours

RNG = np.random.default_rng(8)


def table(spark, vectors, begin=0):
    return spark.createDataFrame([(begin + i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(3)


def rows(df):
    return sorted((r.query_id, r["rank"], r.train_id, "nan" if math.isnan(r.distance) else round(r.distance, 6)) for r in df.collect())


def clustered(n, clusters, width, whole=False):
    centres = RNG.normal(size=(clusters, width)) * 20
    v = centres[RNG.integers(0, clusters, n)] + RNG.normal(size=(n, width))
    return np.rint(v * 50).astype(int) if whole else v


@pytest.mark.parametrize("metric", ["ssd", "sad"])
def test_clusters_take_few_distances(spark, metric):
    v = clustered(6000, 30, 12)
    train, query = table(spark, v), table(spark, v[::60])
    compared = spark.sparkContext.accumulator(0)
    assert rows(pruned.pruned_neighbours(query, train, 5, metric, compared=compared)) == rows(nearest_neighbours(query, train, 5, metric))
    assert compared.value < 0.5 * 6000 * 100  # 32 of them a row are with pivots


def test_bits(spark):
    v = RNG.integers(0, 1 << 12, (900, 2))
    assert rows(pruned.pruned_neighbours(table(spark, v[:90]), table(spark, v, -100), 3, "shd")) == rows(nearest_neighbours(table(spark, v[:90]), table(spark, v, -100), 3, "shd"))


def test_nulls_lengths_ties_and_few_rows(spark):
    v = [*np.rint(RNG.normal(size=(40, 3)) * 2), None, [1.0, None, 2.0], [1.0, 2.0], [5.0, 5.0], [], [7.0], *[[1.0, 1.0, 1.0]] * 5]
    t = table(spark, v, -7)
    for k in (1, 4, 60):
        assert rows(pruned.pruned_neighbours(t, t, k)) == rows(nearest_neighbours(t, t, k))
    assert rows(pruned.pruned_neighbours(t, t.limit(0), 2)) == [] and rows(pruned.pruned_neighbours(t.limit(0), t, 2)) == []


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK", 16)
    v = clustered(300, 5, 4)
    assert rows(pruned.pruned_neighbours(table(spark, v[:50]), table(spark, v), 3)) == rows(nearest_neighbours(table(spark, v[:50]), table(spark, v), 3))
