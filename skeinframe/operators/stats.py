"""Statistics: means, variances, covariance, correlation, median, histogram, moments, norms.

All are aggregates with partial steps. The bias of a variance is explicit:
"population" divides by n, "sample" by n - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.functions.elementwise import div
from skeinframe.operators.reduce import null_safe_join


def mean(v: Column) -> Column:
    return F.avg(v)


def mean_weighted(v: Column, w: Column) -> Column:
    return div(F.sum(v * w), F.sum(w))


def var(v: Column, bias: str = "population") -> Column:
    return F.var_pop(v) if bias == "population" else F.var_samp(v)


def stdev(v: Column, bias: str = "population") -> Column:
    return F.stddev_pop(v) if bias == "population" else F.stddev_samp(v)


def median(v: Column) -> Column:
    """The middle value; of an even number the mean of the middle two. A task holds a group's distinct values: see median_of()."""
    return F.median(v)


#: Values of a group up to which they may meet in one task.
FEW = 1 << 16


def median_of(df: DataFrame, value: str, by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """by, median: exact, also of groups whose values don't fit in a task. NULLs don't count; NaN is the largest value.

    Groups of at most `few` values go by Spark's own median. The others are selected from by counts: a sketch of bounded size a
    group brackets the middle places, one aggregate counts what lies below the bracket and within it, and the bracket is narrowed
    until `few` values or less are left in it, or both its ends are one value. The last step sums up equal values first. Each round
    reads the values of large groups alone and brings two numbers a large group to the driver; there are at most rows / few of them.
    """
    v = F.col("__v")
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(v.isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    large = [tuple(r) for r in sizes.where(F.col("__n") > few).collect()]
    every = df.select(*by).distinct() if by else None
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    spark = df.sparkSession

    def table(found: list[tuple], columns: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(found, ", ".join([*(f"`{c}` {fields[c]}" for c in by), columns])))

    def at(group: tuple, columns: str) -> DataFrame:
        """rows of the large groups with `columns` of each."""
        return null_safe_join(rows, table(group, columns), by) if by else rows.crossJoin(table(group, columns))

    if large:
        n_by, done, open_ = len(by), [], {}
        for g in large:
            # the middle places from 0, apart, as values between them may be many
            for k in {(g[n_by] - 1) // 2, g[n_by] // 2}:
                open_[g[:n_by], k] = (float("-inf"), float("nan"), 0, g[n_by])
        error = 1000
        while open_:
            state = [(*g, k, lo, hi, below, inside) for (g, k), (lo, hi, below, inside) in open_.items()]
            within = at(state, "__k long, __lo double, __hi double, __below long, __inside long").where("__v >= __lo and __v <= __hi")
            keys = [*by, "__k"]
            share = (F.col("__k") - F.col("__below")) / F.col("__inside")
            # the sketch's values at five places each side of the sought one in a thousand
            sketch = within.groupBy(*keys, "__lo", "__hi", "__below", "__inside").agg(F.percentile_approx("__v", [i / error for i in range(error + 1)], 10 * error).alias("__q"))
            first = F.greatest(F.floor(share * error) - 2, F.lit(0)).cast("int")
            last = F.least(F.ceil(share * error) + 2, F.lit(error)).cast("int")
            low = F.when(first == 0, F.col("__lo")).otherwise(F.get("__q", first))
            high = F.when(last == error, F.col("__hi")).otherwise(F.get("__q", last))
            brackets = [tuple(r) for r in sketch.select(*keys, low, high).collect()]
            b = at(brackets, "__k long, __lo double, __hi double")
            counted = b.groupBy(*keys, "__lo", "__hi").agg(F.count_if(F.col("__v") < F.col("__lo")).alias("__below"), F.count_if((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))).alias("__inside"))
            for r in counted.collect():
                g, k, lo, hi, below, inside = r[:n_by], *r[n_by:]
                old = open_.pop((g, k))
                if not below <= k < below + inside:  # the sketch was off: the bracket stays, by another sketch
                    lo, hi, below, inside = old
                    error *= 2
                if inside <= few or lo == hi or inside == old[3]:
                    done.append((*g, k, lo, hi, below))
                else:
                    open_[g, k] = lo, hi, below, inside
        last_ = at(done, "__k long, __lo double, __hi double, __below long").where("__v >= __lo and __v <= __hi")
        equal = last_.groupBy(*by, "__k", "__below", "__v").agg(F.count("*").alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy(*by, "__k").orderBy("__v")) + F.col("__below")
        sought = equal.withColumn("__upto", upto).where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__c") <= F.col("__k")))
        big = sought.groupBy(*by).agg(F.avg("__v").alias("median"))
        names = table([(*g[:n_by], 1) for g in large], "__large int")
        small = null_safe_join(rows, names, by, "left_anti") if by else rows.where("false")
    else:
        big, small = None, rows
    out = small.groupBy(*by).agg(F.median("__v").alias("median"))
    if not by:
        return out if big is None else big
    out = out if big is None else out.unionByName(big)
    return null_safe_join(every, out, by, "left").select(*by, "median")


def corrcoef(x: Column, y: Column) -> Column:
    return F.corr(x, y)


def cov(x: Column, y: Column, bias: str = "population") -> Column:
    return F.covar_pop(x, y) if bias == "population" else F.covar_samp(x, y)


def var_weighted(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), bias: str = "population") -> DataFrame:
    """by, mean, var: sum w (x - mean)^2 / sum w (less 1 for "sample"). A row with a NULL value or weight counts in neither.

    Two aggregates: the lanes' means, then squares about each lane's own mean, so that lanes far apart or with NaN don't touch
    each other's results.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    rows = df.select(*by, v.alias("__v"), w.alias("__w")).where("__v is not null and __w is not null")
    means = rows.groupBy(*by).agg(F.sum("__w").alias("__total"), div(F.sum(F.col("__w") * F.col("__v")), F.sum("__w")).alias("mean"))
    off = F.col("__v") - F.col("mean")
    if by:
        sums = null_safe_join(rows, means, by).groupBy(*by).agg(F.first("mean").alias("mean"), F.first("__total").alias("__total"), F.sum(F.col("__w") * off * off).alias("__s"))
    else:
        mean_, total = means.select("mean", "__total").first()
        off = F.col("__v") - F.lit(mean_)
        sums = rows.agg(F.lit(mean_).cast("double").alias("mean"), F.lit(total).cast("double").alias("__total"), F.sum(F.col("__w") * off * off).alias("__s"))
    part = F.col("__total") if bias == "population" else F.col("__total") - 1
    out = sums.select(*by, "mean", div(F.col("__s"), part).alias("var"))
    # lanes without any value and weight keep their row
    return null_safe_join(df.select(*by).distinct(), out, by, "left").select(*by, "mean", "var") if by else out


def meanvar(df: DataFrame, value: str, by: Sequence[str] = (), bias: str = "population") -> DataFrame:
    return df.groupBy(*by).agg(mean(F.col(value)).alias("mean"), var(F.col(value), bias).alias("var"))


def bin_of(v: Column, nbins: int, low: float, high: float) -> Column:
    """The bin of a value: out of range ones go to the first or last bin."""
    step = (high - low) / nbins
    at = (v.cast("double") - low) / step
    return F.least(F.greatest(at, F.lit(0.0)), F.lit(nbins - 1.0)).cast("int")


def histogram(df: DataFrame, value: str, nbins: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """by, bin, count; empty bins have count 0. NaN and NULL count in no bin."""
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, bin_of(F.col(value), nbins, low, high).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = F.broadcast(spark.range(nbins).select(F.col("id").cast("int").alias("bin")))
    grid = df.select(*by).distinct().crossJoin(bins) if by else bins
    return null_safe_join(grid, counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("count", F.lit(0)).alias("count"))


def moments(df: DataFrame, value: str = "v", x: str = "d0", y: str = "d1", by: Sequence[str] = ()) -> DataFrame:
    """m00, m01, m10, m11: sums of v, x v, y v, x y v."""
    v, x, y = F.col(value), F.col(x), F.col(y)
    return df.groupBy(*by).agg(F.sum(v).alias("m00"), F.sum(x * v).alias("m01"), F.sum(y * v).alias("m10"), F.sum(x * y * v).alias("m11"))


def vector_norm(v: Column, p: float = 2.0) -> Column:
    """The p-norm of all elements; p may be infinite."""
    size = F.abs(v.cast("double"))
    if p == float("inf"):
        return F.max(size)
    if p == 1:
        return F.sum(size)
    return F.sqrt(F.sum(size * size)) if p == 2 else F.pow(F.sum(F.pow(size, F.lit(p))), F.lit(1 / p))


def matrix_norm(df: DataFrame, kind: str, value: str = "v", row: str = "d0", column: str = "d1", p: float = 1.0, q: float = 1.0) -> DataFrame:
    """kind "1": largest column sum; "inf": largest row sum; "pq": p-norms of the columns, their q-norm. One row: norm."""
    if kind == "pq":
        columns = df.groupBy(column).agg(vector_norm(F.col(value), p).alias("s"))
        return columns.agg(vector_norm(F.col("s"), q).alias("norm"))
    sums = df.groupBy(column if kind == "1" else row).agg(F.sum(F.abs(value)).alias("s"))
    return sums.agg(F.max("s").alias("norm"))
