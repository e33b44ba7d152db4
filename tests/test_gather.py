"""Index tensors: gathering and scattering by tables, literals and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.operators import gather
from skeinframe.operators.tensor import Tensor
from tests.test_plans import plan


def vector(spark, values, dtype="f64"):
    return Tensor.host(spark, values, dtype=dtype)


def values(t):
    return [r["v"] for r in t.df.orderBy("d3", "d2", "d1", "d0").collect()]


def test_out_of_range_null_and_repeated_indices(spark):
    t = vector(spark, [10.0, 11.0, 12.0])
    assert values(t[vector(spark, [2, 0, -1, -2, 3, 4, None, 2], "s64")]) == [12.0, 10.0, 10.0, 11.0, 12.0, 11.0, None, 12.0]
    assert values(t[vector(spark, [False, True, True], "b8")]) == [11.0, 12.0]
    assert values(t[[0, -1]]) == [10.0, 10.0]


def test_the_last_of_repeated_places_wins(spark):
    t = vector(spark, [0.0] * 4)
    at = vector(spark, [1, 3, 1, None, -1], "s64")
    assert values(t.assign(at, vector(spark, [1.0, 2.0, 3.0, 4.0, 5.0]))) == [5.0, 3.0, 0.0, 2.0]
    assert values(t.assign([1, -2], 9.0)) == [0.0, 9.0, 0.0, 0.0]
    assert values(t.assign(vector(spark, [2], "s64"), vector(spark, [None]))) == [0.0, 0.0, None, 0.0]


def test_both_dimensions_by_tensors(spark):
    a = np.arange(20.0).reshape(4, 5)
    t = Tensor.host(spark, a.ravel(order="F").tolist(), [4, 5])
    i, j = [3, 0, 3], [4, 4, 1]
    ti, tj = vector(spark, i, "s64"), vector(spark, j, "s64")
    assert values(t[ti, tj]) == a[np.ix_(i, j)].ravel(order="F").tolist()
    b = a.copy()
    b[np.ix_([3, 0], [1, 2])] = [[-1, -2], [-3, -4]]
    put = Tensor.host(spark, [-1.0, -3.0, -2.0, -4.0], [2, 2])
    assert values(t.assign((vector(spark, [3, 0], "s64"), vector(spark, [1, 2], "s64")), put)) == b.ravel(order="F").tolist()


def test_empty_index_and_empty_tensor(spark):
    t = vector(spark, [1.0, 2.0])
    none = Tensor(spark.range(0).selectExpr("id d0", "id d1", "id d2", "id d3", "id v"), (0, 1, 1, 1), "s64")
    assert t[none].dims == (0, 1, 1, 1) and values(t[none]) == []
    assert values(t.assign(none, 5.0)) == [1.0, 2.0]
    with pytest.raises(IndexError):
        Tensor(none.df, (0, 1, 1, 1))[vector(spark, [0], "s64")]


def test_hot_indices_and_many_lanes_are_split(spark):
    """The join beyond the size of a broadcast gives the same rows; a hot index's rows are in many parts."""
    n, lanes, m = 5, 30, 400
    cells = spark.range(n * lanes).select((F.col("id") % n).alias("d0"), F.floor(F.col("id") / n).alias("d1"), F.col("id").cast("double").alias("v"))
    index = spark.range(m).select(F.col("id").alias("__to"), F.when(F.col("id") % 3 > 0, 2).otherwise(F.col("id") % n).cast("long").alias("d0"))
    plain = sorted(map(tuple, cells.join(index, "d0").select("d0", "d1", "v", "__to").collect()))
    for unique in (False, True):
        met = gather.meet(cells, index, "d0", m, lanes, unique, small=0 if unique else 10, part=8)
        assert sorted(map(tuple, met.select("d0", "d1", "v", "__to").collect())) == plain


def test_a_million_indices_stay_on_the_executors(spark):
    """Index of 1.2 million places, half of them one place: by the join of parts."""
    m = 1_200_000
    index = Tensor.grid(spark, [m], F.when(F.col("i") % 2 == 0, 3).otherwise(F.col("i") % 1000), "s64")
    t = Tensor.grid(spark, [1000], F.col("i") * 2.0)
    out = t[index]
    assert "__part" in plan(out.df)
    got = out.df.agg(F.count("v"), F.sum(F.when(F.col("d0") % 2 == 0, F.col("v") - 6).otherwise(F.col("v") - 2 * (F.col("d0") % 1000)))).first()
    assert tuple(got) == (m, 0.0)
