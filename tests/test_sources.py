import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.operators import dense
from skeinframe.operators.tensor import Tensor
from skeinframe.plans import programs
from skeinframe.sources import files
from skeinframe.sources.random import RandomEngine, randu, set_seed
from skeinframe.streaming import stateful


def test_arrays_by_key(spark, tmp_path):
    a, b = Tensor.host(spark, [1.0, 2.0, 3.0, 4.0], [2, 2]), Tensor.host(spark, [5, 6], [2], "s64")
    path = str(tmp_path / "box")
    files.save_array(a, "a", path)
    files.save_array(b.cast("f64"), "b", path, append=True)
    assert files.keys(spark, path) == ["a", "b"]
    back = files.read_array(spark, path, "a")
    assert back.values() == [1, 2, 3, 4] and back.dims == (2, 2, 1, 1)
    with pytest.raises(KeyError):
        files.read_array(spark, path, "c")


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.5\n3 1 -1\n2 2 4\n")
    t = files.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    assert np.array(t.values()).reshape(3, 3).tolist() == [[2.5, 0, -1], [0, 4, 0], [-1, 0, 0]]


@pytest.mark.parametrize("kind", ["png", "ppm", "bmp"])
def test_images(spark, tmp_path, kind):
    images = [np.random.default_rng(i).integers(0, 256, (5, 7, 3)).astype(float) for i in range(3)]
    rows = files.encode_images(dense.host(spark, images, "image"), kind=kind).orderBy("id").collect()
    for r in rows:
        (tmp_path / f"{r['id']}.{kind}").write_bytes(bytes(r["content"]))
    back = files.load_images(spark, str(tmp_path)).orderBy("path").withColumn("id", F.col("path"))
    for a, b in zip(images, dense.collect(back, "image")):
        np.testing.assert_array_equal(a, b)
    assert files.decode_image(b"nothing") is None


def test_random(spark):
    for kind in ("philox", "threefry", "mersenne", "hash"):
        one, two = RandomEngine(kind, 3), RandomEngine(kind, 3)
        whole = one.uniform(spark, [100]).values()
        assert two.uniform(spark, [60]).values() + two.uniform(spark, [40]).values() == pytest.approx(whole)
        z = np.array(RandomEngine(kind, 4).normal(spark, [20000]).df.select("v").toPandas()["v"])
        assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    set_seed(1)
    first = randu(spark, 5).values()
    set_seed(1)
    assert randu(spark, 5).values() == first


def test_programs(spark):
    pi = programs.monte_carlo_pi(spark, 400_000).first()["pi"]
    assert abs(pi - np.pi) < 0.02
    a = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 5]])
    b = np.array([1.0, 2, 3])
    x = programs.conjugate_gradient(Tensor.host(spark, a.ravel(order="F").tolist(), [3, 3]), Tensor.host(spark, b.tolist()), 5)
    np.testing.assert_allclose(x.values(), np.linalg.solve(a, b), atol=1e-8)
    blinker = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "d0 long, d1 long")
    assert sorted(map(tuple, programs.life(blinker).collect())) == [(0, 1), (1, 1), (2, 1)]
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.2, (50, 2)), rng.normal(5, 0.2, (50, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, v array<double>")
    out, centres = programs.kmeans(df, 2)
    clusters = [r["cluster"] for r in out.orderBy("i").collect()]
    assert len(set(clusters[:50])) == len(set(clusters[50:])) == 1 and clusters[0] != clusters[99] and len(centres) == 2
    classes = df.withColumn("y", (F.col("i") >= 50).cast("int")).withColumn("a", F.col("v")[0]).withColumn("b", F.col("v")[1])
    model = programs.naive_bayes_fit(classes, "y", ["a", "b"])
    got = programs.naive_bayes_predict(classes, model, "y", ["a", "b"], "i").orderBy("i").collect()
    assert [r["predicted"] for r in got] == [0] * 50 + [1] * 50
    option = programs.black_scholes(spark.createDataFrame([(100.0, 100.0, 0.05, 0.2, 1.0)], "s double, x double, r double, v double, t double")).first()
    assert option["call"] == pytest.approx(10.4505835) and option["put"] == pytest.approx(5.5735260)
    rain = spark.createDataFrame([(0, 1, 2.0), (1, 1, 0.0), (0, 3, 1.5), (1, 4, 4.0)], "site int, day int, m double")
    sites, days, n = programs.rainfall(rain, "site", "day", "m")
    assert n == 3 and {r["site"]: (r["total"], r["rainy"]) for r in sites.collect()} == {0: (3.5, 2), 1: (4.0, 1)} and days.count() == 3


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", h % 2, float(h * 60 + m)) for h in range(5) for m in range(0, 60, 20)], "t string, k int, v double").withColumn("t", F.to_timestamp("t"))
    source = str(tmp_path / "events")
    events.repartition(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = stateful.windowed(stream, "t", "v", ["k"]).writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("w")) == key(stateful.windowed(events, "t", "v", ["k"])) and spark.table("w").count() == 5
    assert stateful.sessions(events, "t", "v", ["k"], "30 minutes").count() == 5
    numbered = events.withColumn("n", F.unix_seconds("t"))
    numbered.repartition(1).write.parquet(str(tmp_path / "numbered"))
    stream = spark.readStream.schema(numbered.schema).parquet(str(tmp_path / "numbered"))
    query = stateful.running_filter(stream, "k", "n", "v", [1.0], [1.0, -1.0]).writeStream.outputMode("append").format("memory").queryName("f").start()
    query.processAllAvailable()
    query.stop()
    sums = {}
    for r in numbered.orderBy("n").collect():
        sums[r["k"]] = sums.get(r["k"], 0.0) + r["v"]
    last = {r["k"]: r["y"] for r in spark.table("f").orderBy("n").collect()}
    assert last == pytest.approx(sums)
