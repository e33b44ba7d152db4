"""End-to-end programs over the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.functions import elementwise as E
from skeinframe.operators.tensor import Tensor
from skeinframe.sources.random import hashed_uniform


def masked_aggregation(lineitem: DataFrame) -> DataFrame:
    """Revenue of moderately discounted, small orders per return flag."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    mask = E.logical_and(E.ge(F.col("l_discount"), 0.05), E.le(F.col("l_discount"), 0.07)) & E.lt(F.col("l_quantity"), 24)
    kept = lineitem.where(mask).select("l_returnflag", revenue.alias("revenue"))
    return kept.groupBy("l_returnflag").agg(F.sum("revenue").alias("sum_revenue"), F.count(F.lit(1)).alias("n"), F.avg("revenue").alias("mean_revenue"), F.var_samp("revenue").alias("var_revenue"))


def rainfall(df: DataFrame, site: str, day: str, measurement: str) -> tuple[DataFrame, DataFrame, int]:
    """(total and rainy days per site, total per day, days with a measurement)."""
    sites = df.groupBy(site).agg(F.sum(measurement).alias("total"), F.count_if(F.col(measurement) > 0).alias("rainy"))
    days = df.groupBy(day).agg(F.sum(measurement).alias("total"))
    return sites, days, df.agg(F.count_distinct(day)).first()[0]


def black_scholes(df: DataFrame, s: str = "s", x: str = "x", r: str = "r", v: str = "v", t: str = "t") -> DataFrame:
    """df with call and put prices of European options."""
    cdf = lambda d: 0.5 * E.erfc(-d / math.sqrt(2))
    s, x, r, v, t = map(F.col, (s, x, r, v, t))
    root = v * F.sqrt(t)
    d1 = (F.log(s / x) + (r + v * v * 0.5) * t) / root
    now = x * F.exp(-r * t)
    call: Column = s * cdf(d1) - now * cdf(d1 - root)
    return df.withColumn("call", call).withColumn("put", call + now - s)


def monte_carlo_pi(spark: SparkSession, samples: int, seed: int = 0) -> DataFrame:
    """pi: four times the share of random points that lie in the quarter circle. No shuffle but one row a task."""
    x, y = hashed_uniform(F.col("id"), 2 * seed), hashed_uniform(F.col("id"), 2 * seed + 1)
    return spark.range(samples).agg((4.0 * F.count_if(x * x + y * y < 1) / F.count(F.lit(1))).alias("pi"))


def kmeans(points: DataFrame, k: int, iterations: int = 20, tolerance: float = 1e-6, vector: str = "v") -> tuple[DataFrame, list[list[float]]]:
    """(points with their cluster, centres). Centres are k rows and live on the driver; each round is one aggregate over the points.

    Starts from the k points that come first by hash.
    """
    first = points.select(vector, F.xxhash64(vector).alias("h")).orderBy("h").limit(k).collect()
    centres = [[float(x) for x in r[vector]] for r in first]

    def assigned() -> DataFrame:
        lists = [F.array(*map(F.lit, c)) for c in centres]
        total = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda p, q: p + q)
        return points.withColumn("cluster", F.array_min(F.array(*[F.struct(total(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(lists)]))["i"])

    for _ in range(iterations):
        means = assigned().select("cluster", F.posexplode(vector).alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("m")).collect()
        new = [list(c) for c in centres]
        for r in means:  # k * dimensions rows
            new[r["cluster"]][r["p"]] = float(r["m"])
        moved = max((abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)), default=0.0)
        centres = new
        if moved <= tolerance:
            break
    return assigned(), centres


def naive_bayes_fit(df: DataFrame, label: str, features: list[str], smoothing: float = 1e-9) -> DataFrame:
    """A row per class: prior, and means and variances of the features."""
    total = df.count()
    aggregates = [f for x in features for f in (F.avg(x).alias(f"m_{x}"), (F.var_pop(x) + smoothing).alias(f"s_{x}"))]
    return df.groupBy(label).agg((F.count(F.lit(1)) / F.lit(float(total))).alias("prior"), *aggregates)


def naive_bayes_predict(df: DataFrame, model: DataFrame, label: str, features: list[str], key: str) -> DataFrame:
    """key, predicted: the class of the largest log-likelihood. The classes' rows are held on the driver and become literals."""
    classes = model.collect()

    def likelihood(c) -> Column:
        out = F.lit(math.log(c["prior"]))
        for x in features:
            out = out - 0.5 * F.log(F.lit(2 * math.pi * c[f"s_{x}"])) - (F.col(x) - c[f"m_{x}"]) ** 2 / (2 * c[f"s_{x}"])
        return out

    best = F.array_max(F.array(*[F.struct(likelihood(c).alias("l"), F.lit(c[label]).alias("c")) for c in classes]))
    return df.select(key, best["c"].alias("predicted"))


def conjugate_gradient(a: Tensor, b: Tensor, iterations: int = 10, tolerance: float = 1e-10) -> Tensor:
    """x of a x = b, for a symmetric positive definite a, dense or sparse. Vectors are evaluated every round, so plans don't grow."""
    x = b.map(lambda v: v * 0.0)
    r, p = b.eval(), b.eval()
    rr = r.dot(r).scalar()
    for _ in range(iterations):
        ap = a.matmul(p).eval()
        alpha = rr / p.dot(ap).scalar()
        x = x.zip(p, lambda u, v: u + alpha * v).eval()
        r = r.zip(ap, lambda u, v: u - alpha * v).eval()
        new = r.dot(r).scalar()
        if new < tolerance:
            break
        beta = new / rr
        p, rr = r.zip(p, lambda u, v: u + beta * v).eval(), new
    return x


def life(cells: DataFrame, x: str = "d0", y: str = "d1") -> DataFrame:
    """The next generation of a sparse board of living cells: eight rows a cell, then one aggregate."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(int(i == j == 0)).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = cells.select(x, y, F.explode(offsets).alias("o")).select((F.col(x) + F.col("o.i")).alias(x), (F.col(y) + F.col("o.j")).alias(y), F.col("o.own").alias("own"))
    counts = near.groupBy(x, y).agg(F.sum(1 - F.col("own")).alias("n"), F.max("own").alias("alive"))
    return counts.where((F.col("n") == 3) | ((F.col("n") == 2) & (F.col("alive") == 1))).select(x, y)
