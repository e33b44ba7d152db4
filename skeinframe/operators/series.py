"""Operators on long one-dimensional series held as rows: filters, moving windows, interpolation, gradients.

Lanes (`by`) are worked on in parallel; the order column must be unique in a lane.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lane(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def fir(df: DataFrame, value: str, b: Sequence[float], order: Sequence[str], by: Sequence[str], name: str = "fir") -> DataFrame:
    """y[i] = sum b[k] x[i-k], zero before the start. One window sort for all taps."""
    w = _lane(by, order)
    total = F.lit(0.0)
    for k, c in enumerate(b):
        total = total + c * (F.col(value) if k == 0 else F.coalesce(F.lag(value, k).over(w), F.lit(0.0)))
    return df.withColumn(name, total)


def convolve1(df: DataFrame, value: str, kernel: Sequence[float], order: Sequence[str], by: Sequence[str], name: str = "conv") -> DataFrame:
    """Same length as the series, starting at half the kernel's length; zero borders."""
    w, half = _lane(by, order), len(kernel) // 2
    total = F.lit(0.0)
    for k, c in enumerate(kernel):
        back = k - half
        x = F.col(value) if back == 0 else F.coalesce((F.lag(value, back) if back > 0 else F.lead(value, -back)).over(w), F.lit(0.0))
        total = total + c * x
    return df.withColumn(name, total)


def iir(column: Column, b: Sequence[float], a: Sequence[float]) -> Column:
    """In-row form: the recursive filter b / a along an array of doubles, in the JVM.

    The state is the last outputs, the outputs of this stretch of 64 and those of whole stretches, so that little is copied.
    """
    b, a = [x / a[0] for x in b], [x / a[0] for x in a]
    start = F.struct(F.array().cast("array<array<double>>").alias("done"), F.array().cast("array<double>").alias("y"), F.array_repeat(F.lit(0.0), len(a) - 1).alias("last"))
    taps = lambda i: sum((F.when(i >= k, c * F.get(column, i - k)).otherwise(0.0) for k, c in enumerate(b)), F.lit(0.0))

    def step(state: Column, i: Column) -> Column:
        last, full = state["last"], i % 64 == 63
        back = sum((F.get(last, F.lit(len(a) - 1 - k)) * -c for k, c in enumerate(a) if k), F.lit(0.0))
        new = F.array(taps(i) + back)
        grown = F.concat(state["y"], new)
        done = F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"])
        rest = F.when(full, F.array().cast("array<double>")).otherwise(grown)
        return F.struct(done.alias("done"), rest.alias("y"), (F.slice(F.concat(last, new), 2, len(a) - 1) if len(a) > 1 else last).alias("last"))

    return F.when(F.size(column) == 0, F.array().cast("array<double>")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(column), F.lit(1)) - 1), start, step, lambda s: F.concat(F.flatten(s["done"]), s["y"])))


def moving(df: DataFrame, value: str, width: int, order: Sequence[str], by: Sequence[str], op: str = "median", name: str = "moving") -> DataFrame:
    """min, max, mean or median over `width` rows about each; at a lane's ends, over those there are."""
    w = _lane(by, order).rowsBetween(-(width // 2), width - 1 - width // 2)
    f = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}[op]
    return df.withColumn(name, f(value).over(w))


def medfilt1(df: DataFrame, value: str, width: int, order: Sequence[str], by: Sequence[str], name: str = "medfilt") -> DataFrame:
    """Median over `width` (odd) rows, with zeros beyond a lane's ends."""
    w, half = _lane(by, order), width // 2
    near = [F.col(value).cast("double") if k == 0 else F.coalesce((F.lag(value, -k) if k < 0 else F.lead(value, k)).over(w).cast("double"), F.lit(0.0)) for k in range(-half, half + 1)]
    return df.withColumn(name, F.element_at(F.array_sort(F.array(*near)), half + 1))


def gradient(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], name: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = _lane(by, order)
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(name, F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2))


def approx1(positions: DataFrame, series: DataFrame, pos: str, index: str, value: str, length: int, method: str = "linear", off_grid: float = 0.0, start: float = 0.0, step: float = 1.0, name: str = "approx") -> DataFrame:
    """positions with the series' value at pos (its grid begins at start, by step); methods nearest, lower, linear, cosine.

    An equi-join on the whole part of the position: each series row carries its next one's value.
    """
    import math

    carried = series.select(F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__v0"))
    after = carried.select((F.col("__i") - 1).alias("__i"), F.col("__v0").alias("__v1"))
    pairs = carried.join(after, "__i", "left")
    x = (F.col(pos) - start) / step
    base = F.floor(x + 0.5) if method == "nearest" else F.floor(x)
    joined = positions.withColumn("__x", x).withColumn("__i", base.cast("long")).join(pairs, "__i", "left")
    t = F.col("__x") - F.col("__i")
    if method == "cosine":
        t = (1 - F.cos(math.pi * t)) / 2
    v = F.col("__v0") if method in ("nearest", "lower") else F.when(t == 0, F.col("__v0")).otherwise((1 - t) * F.col("__v0") + t * F.col("__v1"))
    inside = (F.col("__x") >= 0) & (F.col("__x") <= length - 1)
    return joined.withColumn(name, F.when(inside, v).otherwise(off_grid)).drop("__x", "__i", "__v0", "__v1")
