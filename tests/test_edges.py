"""Values that are missing, infinite, far apart or beyond 64 bits, and lanes and positions that are NULL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe import dtypes
from skeinframe.functions import elementwise as E
from skeinframe.operators import neighbours, order, reduce, scan, stats
from skeinframe.operators.tensor import Tensor

INF, NAN = float("inf"), float("nan")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_weighted_variance_of_lanes_far_apart_and_with_nan(spark):
    data = [("z", float(x), 1.0) for x in range(9)] + [("far", 1e12 + x, 2.0) for x in range(3)] + [("nan", NAN, 1.0), ("nan", 1.0, 1.0), (None, 4.0, 1.0), (None, 6.0, 3.0), ("none", None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double, w double")
    got = {r["k"]: (r["mean"], r["var"]) for r in stats.var_weighted(df, "v", "w", ["k"]).collect()}
    assert got["z"] == (4.0, pytest.approx(60 / 9)) and got["far"] == (1e12 + 1, pytest.approx(2 / 3)) and got[None] == (5.5, pytest.approx(0.75))
    assert math.isnan(got["nan"][1]) and got["none"] == (None, None)
    one = stats.var_weighted(df.where("k = 'z'"), "v", "w", bias="sample").first()
    assert (one["mean"], one["var"]) == (4.0, pytest.approx(60 / 8))


def test_histogram_of_null_and_infinite_values_and_null_lanes(spark):
    df = spark.createDataFrame([("a", None), ("a", INF), ("a", -INF), ("a", 5.0), (None, 1.0), (None, 9.0), (None, NAN)], "k string, v double")
    got = {}
    for r in stats.histogram(df, "v", 2, 0.0, 10.0, ["k"]).collect():
        got.setdefault(r["k"], {})[r["bin"]] = r["count"]
    assert got == {"a": {0: 1, 1: 2}, None: {0: 1, 1: 1}}
    assert [r["count"] for r in stats.histogram(df, "v", 2, 0.0, 10.0).orderBy("bin").collect()] == [2, 3]


def test_rows_without_a_position_come_first_in_scans_and_runs(spark):
    df = spark.createDataFrame([(None, "a", 5.0), (0, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0)], "i int, k string, v double")
    assert rows(scan.scan(df, "v", ["i"]).select("i", "scan"), "i") == [(None, 5.0), (0, 6.0), (1, 8.0), (2, 11.0)]
    assert rows(scan.scan(df, "v", ["i"], inclusive=False).select("i", "scan"), "i") == [(None, 0.0), (0, 5.0), (1, 6.0), (2, 8.0)]
    assert rows(reduce.runs(df, "k", ["i"]).select("i", "run"), "i") == [(None, 0), (0, 0), (1, 1), (2, 1)]
    assert [r["sum"] for r in reduce.reduce_by_key(df, "k", "v", ["i"], ["sum"]).orderBy("run").collect()] == [6.0, 5.0]
    laned = df.withColumn("lane", F.lit(1))
    assert rows(reduce.runs(laned, "k", ["i"], ["lane"]).select("i", "run"), "i") == rows(reduce.runs(df, "k", ["i"]).select("i", "run"), "i")


def test_null_lanes_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0), (7, 0, 3.0)], "k int, i int, v double")
    assert rows(scan.shift(df, "v", ["i"], ["k"], 1).select("k", "i", "shifted"), "k", "i") == [(None, 0, 2.0), (None, 1, 1.0), (7, 0, 3.0)]
    lengths = spark.createDataFrame([(None, 1), (7, 1)], "k int, n int")
    assert rows(reduce.max_ragged(df, "v", "i", lengths, "n", ["k"]), "k") == [(None, 1.0, 0), (7, 3.0, 0)]


def test_whole_numbers_wrap_around(spark):
    top = (1 << 63) - 1
    wrap = lambda x, bits=64: (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    pairs = [(top, 1), (-top - 1, -1), (top, top), (-top - 1, -top - 1), (123456789123, -987654321987), (-1, 1 << 62), (0, 5), (3, -4)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", E.add(F.col("a"), F.col("b"), "s64").alias("add"), E.sub(F.col("a"), F.col("b"), "s64").alias("sub"), E.mul(F.col("a"), F.col("b"), "s64").alias("mul"), E.mul(F.col("a"), F.col("b"), "s16").alias("short")).collect()
    for a, b, add, sub, mul, short in got:
        assert (add, sub, mul, short) == (wrap(a + b), wrap(a - b), wrap(a * b), wrap(a * b, 16))
    assert reduce.reduce(df, "a", ["sum"]).first()[0] == wrap(sum(a for a, _ in pairs))
    df = spark.createDataFrame([(INF,), (-INF,), (NAN,), (-2.9,), (1e19,), (None,)], "x double")
    assert [r[0] for r in df.select(dtypes.cast(F.col("x"), "f64", "s32")).collect()] == [-1, 0, 0, -2, -1, None]
    assert [r[0] for r in df.select(dtypes.cast(F.col("x"), "f64", "s64")).collect()] == [top, -top - 1, 0, -2, top, None]


def test_products_of_nulls_are_zeros_at_any_size(spark, monkeypatch):
    from skeinframe.operators import tensor

    a = Tensor.of(spark.createDataFrame([(0, 0, None), (0, 1, None), (1, 0, 2.0), (1, 1, None)], "d0 long, d1 long, v double"), [2, 2])
    small = rows(a.matmul(a).df.select("d0", "d1", "v"), "d0", "d1")
    monkeypatch.setattr(tensor, "JOINED_PRODUCTS", 0)
    assert small == rows(a.matmul(a).df.select("d0", "d1", "v"), "d0", "d1") == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 0.0)]


def test_neighbours_of_unequal_length(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [3.0, 3.0]), (4, None), (5, [])], "id long, v array<double>")
    query = spark.createDataFrame([(10, [1.0, 1.0]), (11, [0.0, 0.0, 0.0]), (12, [1.0])], "id long, v array<double>")
    assert rows(neighbours.nearest_neighbours(query, train, 2), "query_id", "rank") == [(10, 0, 1, 2.0), (10, 1, 3, 8.0), (11, 0, 2, 3.0)]


def test_ranks_over_all_rows(spark):
    rng = np.random.default_rng(3)
    values = [None if x == 3 else NAN if x == 5 else float(x) for x in np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 40, 3000)).tolist()]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(13)
    for ascending in (True, False):
        key = lambda i: (values[i] is not None, values[i] != values[i] if values[i] is not None else False, values[i] if values[i] is not None and values[i] == values[i] else 0)
        want = sorted(range(3000), key=lambda i: (key(i) if ascending else tuple(-x for x in key(i)), i))
        got = order.sort_index(df, "v", "i", ascending).orderBy("rank").collect()
        assert [r["index"] for r in got] == want and [r["rank"] for r in got] == list(range(3000))
        pairs = order.sort_by_key(df.withColumn("x", F.col("i") * 2), "v", "x", "i", ascending).orderBy("rank").collect()
        assert [r["value"] for r in pairs] == [2 * i for i in want]
    assert order.sort_index(df.where("false"), "v", "i").count() == 0
    clash = order.numbered(df.withColumnsRenamed({"v": "__at"}), [F.col("__at"), F.col("i")], "place").orderBy("place").collect()
    assert [r["i"] for r in clash] == [r["index"] for r in order.sort_index(df, "v", "i").orderBy("rank").collect()]
    assert "SinglePartition" not in order.sort_index(df, "v", "i")._jdf.queryExecution().toString()
    t = Tensor.host(spark, [3.0, 1.0, 2.0, 1.0], [4]).sort()
    assert list(t.values()) == [1.0, 1.0, 2.0, 3.0]


def test_rank_of_nearly_dependent_columns_is_that_of_its_sql(spark, tmp_path):
    """Arrays of larger tables come within 1e-5 of dependence, and yet have full rank."""
    import duckdb

    import __spark_entry__

    rows = []
    for i, tiny in enumerate([1.0, 1e-6, 1e-12]):
        a = np.eye(8)
        a[0, 0], a[7, 7] = 0.0075, tiny
        rows.append((i, a.T.ravel().tolist()))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in __spark_entry__.queries()["rank"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["rank"]).fetchall()) == [(i, 0, 8.0) for i in range(3)]
