"""Discrete Fourier transforms of series that are tables, of any length, by the six-step method.

A series of n = n1 n2 elements is taken as a matrix: element i = i1 n2 + i2. Columns (of equal i2) are transformed, multiplied by
twiddle factors, dealt out again by the other index, the transposition, and rows are transformed. A task holds columns of n1 or
n2 elements, many at a time. Lanes are transformed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.operators.dense import ship

#: Elements of a column at most: a length with a larger prime factor goes by transforms of a power of two.
LONGEST = 1 << 20


def split(n: int) -> tuple[int, int]:
    """n as a product of two factors, the first at most the second, as near each other as can be."""
    first = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return first, n // first


def _columns(df: DataFrame, lane: str, column: str, row: str, length: int, after) -> DataFrame:
    """Transforms along `row` of (lane, column, row, re, im), each column whole. after(lanes, columns, matrix): what is done with
    a matrix of them, giving arrays for lane, i, re, im."""
    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            lanes, columns, rows, re, im = (c.to_numpy() for c in table.columns)
            if not (rows.reshape(-1, length) == np.arange(length)).all():
                raise ValueError("a series misses elements, or has some twice")
            out = after(lanes[::length], columns[::length], np.fft.fft((re + 1j * im).reshape(-1, length), axis=1))
            return pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in out], ["lane", "i", "re", "im"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if (n := rest.num_rows // length * length) >= max(length, 1 << 14):
                yield done(rest.slice(0, n))
                rest = rest.slice(n)
        if rest is not None and rest.num_rows:
            if rest.num_rows % length:
                raise ValueError("a series misses elements, or has some twice")
            yield done(rest)

    dealt = df.select(lane, column, row, "re", "im").repartition(lane, column).sortWithinPartitions(lane, column, row)
    return dealt.mapInArrow(transformed, "lane long, i long, re double, im double")


def fft_long(df: DataFrame, n: int, inverse: bool = False, lane: str = "lane", index: str = "i", re: str = "re", im: str | None = "im", normalise: float | None = None) -> DataFrame:
    """lane, i, re, im: the transform of each lane's n elements, one at every index from 0; im None: of real ones.

    With inverse, exponents have the other sign and results are divided by n; normalise multiplies by something else instead. NULLs are
    zeros. A lane that misses elements raises an error.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(lane).cast("long").alias("lane"), F.col(index).cast("long").alias("i"), F.coalesce(F.col(re).cast("double"), F.lit(0.0)).alias("re"), F.coalesce(F.col(im).cast("double"), F.lit(0.0)).alias("im") if im else F.lit(0.0).alias("im"))
    if inverse:  # the conjugate of the transform of the conjugate
        out = fft_long(rows.withColumn("im", -F.col("im")), n).withColumn("im", -F.col("im"))
        scale = 1 / n if normalise is None else normalise
    else:
        n1, n2 = split(n)
        if n2 > LONGEST:
            out = _chirped(rows, n)
        else:
            out = _six_steps(rows, n1, n2)
        scale = 1.0 if normalise is None else normalise
    return out if scale == 1 else out.withColumns({"re": F.col("re") * scale, "im": F.col("im") * scale})


def _six_steps(rows: DataFrame, n1: int, n2: int) -> DataFrame:
    n = n1 * n2

    def twiddled(lanes, columns, x):  # columns: i2, along x: k1; they go on as rows of k1
        k1 = np.arange(n1)
        x = x * np.exp(-2j * np.pi * ((columns[:, None] * k1) % n) / n)
        return np.repeat(lanes, n1), k1 * n2 + columns[:, None], x.real, x.imag

    def placed(lanes, columns, x):  # columns: k1, along x: k2
        return np.repeat(lanes, n2), columns[:, None] + n1 * np.arange(n2), x.real, x.imag

    if n1 > 1:
        rows = _columns(rows.withColumns({"i2": F.pmod("i", F.lit(n2)), "i1": F.floor(F.col("i") / n2)}), "lane", "i2", "i1", n1, twiddled)
    return _columns(rows.withColumns({"k1": F.floor(F.col("i") / n2), "i2": F.pmod("i", F.lit(n2))}), "lane", "k1", "i2", n2, placed)


def _chirped(rows: DataFrame, n: int) -> DataFrame:
    """A transform of any length as a cyclic convolution of a power of two's length with a chirp."""
    m = 1 << (2 * n - 2).bit_length()
    spark = rows.sparkSession
    # i^2 mod 2n, without leaving 64 bits, n being below 2^31
    angle = lambda i: F.pmod(i * i, F.lit(2 * n)) * (np.pi / n)
    times = lambda a, b: ((a[0] * b[0] - a[1] * b[1]), (a[0] * b[1] + a[1] * b[0]))
    i = F.col("i")
    down = times((F.col("re"), F.col("im")), (F.cos(angle(i)), -F.sin(angle(i))))
    lanes = rows.select("lane").distinct()
    blank = lanes.join(F.broadcast(spark.range(n, m).select(F.col("id").alias("i"))) if m < LONGEST else spark.range(n, m).select(F.col("id").alias("i")), how="cross").select("lane", "i", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    left = fft_long(rows.select("lane", "i", down[0].alias("re"), down[1].alias("im")).unionByName(blank), m)
    j = F.least(F.col("id"), F.lit(m) - F.col("id"))
    chirp = spark.range(m).select(F.lit(0).cast("long").alias("lane"), F.col("id").alias("i"), F.when(j < n, F.cos(angle(j))).otherwise(0.0).alias("re"), F.when(j < n, F.sin(angle(j))).otherwise(0.0).alias("im"))
    right = fft_long(chirp, m).select("i", F.col("re").alias("cr"), F.col("im").alias("ci"))
    both = times((F.col("re"), F.col("im")), (F.col("cr"), F.col("ci")))
    back = fft_long(left.join(right, "i").select("lane", "i", both[0].alias("re"), both[1].alias("im")), m, True).where(i < n)
    down = times((F.col("re"), F.col("im")), (F.cos(angle(i)), -F.sin(angle(i))))
    return back.select("lane", "i", down[0].alias("re"), down[1].alias("im"))


def fft2_long(df: DataFrame, dims: Sequence[int], inverse: bool = False, row: str = "d0", column: str = "d1", re: str = "re", im: str | None = "im") -> DataFrame:
    """d0, d1, re, im: the transform of a matrix of dims elements along both dimensions."""
    first = fft_long(df, dims[0], inverse, column, row, re, im)
    return fft_long(first, dims[1], inverse, "i", "lane").select(F.col("lane").alias("d0"), F.col("i").alias("d1"), "re", "im")
