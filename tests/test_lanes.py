"""Lanes that hold most of the rows are the work of many tasks."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinframe.functions.kernels import image as I
from skeinframe.operators import order, reduce, stats
from skeinframe.operators.regions import regions
from skeinframe.operators.tensor import Tensor
from skeinframe.plans import registry


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_large_lanes_are_ranked_in_ranges(spark):
    # lanes of 3,000 and 2,000 rows, NULL's the larger, and ten of 10; five values, NULL among them
    i = F.col("id")
    df = spark.range(5100).select(F.when(i < 5000, F.when(i % 5 < 3, None).otherwise(1)).otherwise(i % 10 + 2).alias("k"), F.when(i % 7 > 0, i % 7 % 5).alias("v"), i.alias("i"))
    for ascending in (True, False):
        way = F.col("v").asc() if ascending else F.col("v").desc()
        got = order.sort(df.select("k", "v"), "v", ascending, ["k"], lane=100)
        want = df.select("k", "v").withColumn("rank", (F.row_number().over(Window.partitionBy("k").orderBy(way)) - 1).cast("long"))
        assert got.columns == ["k", "v", "rank"] and rows(got) == rows(want)
    want = df.withColumn("rank", (F.row_number().over(Window.partitionBy("k").orderBy("v", "i")) - 1).cast("long"))
    placed = order.ranked(df, [F.col("v").asc(), F.col("i").asc()], ["k"], "rank", 100)
    assert rows(placed) == rows(want)


def test_no_task_ranks_a_large_lane(spark, monkeypatch):
    sizes, settle = [], order.settle

    def kept(df, name):
        table = settle(df, name)
        sizes.extend(r["count"] for r in table.groupBy(F.shiftright("__at", 33)).count().collect())
        return table

    monkeypatch.setattr(order, "settle", kept)
    df = spark.range(0, 40_000, numPartitions=4).select((F.col("id") % 2).alias("k"), F.lit(1.0).alias("v"))
    got = order.sort(df, "v", False, ["k"], lane=5000)
    assert sum(sizes) == 40_000 and 0 < max(sizes) <= 10_000
    assert got.where("rank >= 20000").count() == 0 and got.select("k", "rank").distinct().count() == 40_000


def test_median_of_all_rows_is_selected_by_counts(spark, monkeypatch):
    def whole(v):
        raise AssertionError("all values would meet in one task")

    monkeypatch.setattr(stats, "median", whole)
    monkeypatch.setattr(stats.median_of, "__defaults__", ((), 1000))
    data = "/root/testdata/sf0.001"
    got = registry.queries()["statistics_all"](spark, data).first()
    prices = sorted(r[0] for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_extendedprice").collect())
    middle = (prices[(len(prices) - 1) // 2] + prices[len(prices) // 2]) / 2
    assert got.asDict().keys() == {"mean", "var", "median", "corrcoef"} and abs(got["median"] - middle) < 1e-3


def test_runs_of_many_lanes_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(reduce, "SHARE", 100, raising=False)
    i = F.col("id")
    df = spark.range(2000).select(F.floor(i / 4).alias("lane"), (i % 4).alias("pos"), F.floor(i % 4 / 2).alias("k"), i.cast("double").alias("v"))
    out = reduce.reduce_by_key(df, "k", "v", ["pos"], ["sum", "count"], ["lane"])
    assert out.rdd.getNumPartitions() >= 20
    assert rows(out) == sorted(((n, run, run, 8.0 * n + 4 * run + 1, 2 - (n == run == 0)) for n in range(500) for run in range(2)), key=str)


def test_elements_of_no_region_do_not_meet(spark):
    a = np.zeros((40, 50))
    a[3:9, 20:31] = a[30:, 45:] = 1
    got = regions(Tensor.host(spark, a.ravel(order="F").tolist(), [40, 50]), 4, tile=16)
    assert "LeftOuter" not in got.df._jdf.queryExecution().toString()
    np.testing.assert_array_equal(np.asarray(got.values()).reshape(40, 50, order="F"), I.regions(a, 4))
