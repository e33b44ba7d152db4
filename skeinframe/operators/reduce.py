"""Reductions of columns: over all rows, over groups, and over runs of equal keys.

Every reduction is an aggregate with a partial step before the shuffle. `by` names
the columns that stay (the lanes); none reduces everything to one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.functions.elementwise import true, wrapped_add

INF = float("inf")
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _not_nan(v: Column) -> Column:
    return F.when(~F.isnan(v.cast("double")), v)


def _filled(v: Column, nanval: float | None) -> Column:
    return v if nanval is None else F.when(F.isnan(v.cast("double")), F.lit(float(nanval))).otherwise(v)


def sum_(v: Column, nanval: float | None = None) -> Column:
    """NaN propagates, or counts as nanval. Whole numbers: see sum_whole()."""
    return F.sum(_filled(v, nanval))


def sum_whole(v: Column) -> Column:
    """The sum of whole numbers in 64 bits that wraps around, as machine integers do, where Spark's sum raises an error.

    Three pieces of the number's bits are added up apart, none of which 2^41 rows can overflow.
    """
    v = v.cast("long")
    piece = F.lit((1 << 22) - 1)
    low, middle, high = F.sum(v.bitwiseAND(piece)), F.sum(F.shiftright(v, 22).bitwiseAND(piece)), F.sum(F.shiftright(v, 44))
    return wrapped_add(F.shiftleft(high, 44), wrapped_add(F.shiftleft(middle, 22), low))


def product(v: Column, nanval: float | None = None) -> Column:
    return F.product(_filled(v, nanval).cast("double"))


def min_(v: Column) -> Column:
    """NaN is skipped; all NaN gives +inf."""
    return F.coalesce(F.min(_not_nan(v)), F.when(F.count(v) > 0, F.lit(INF)))


def max_(v: Column) -> Column:
    """NaN is skipped; all NaN gives -inf."""
    return F.coalesce(F.max(_not_nan(v)), F.when(F.count(v) > 0, F.lit(-INF)))


def count(v: Column) -> Column:
    """Of elements that aren't zero."""
    return F.count_if(true(v))


def all_true(v: Column) -> Column:
    return F.bool_and(true(v))


def any_true(v: Column) -> Column:
    return F.bool_or(true(v))


def argmin(v: Column, pos: Column) -> tuple[Column, Column]:
    """(value, position); of ties the last. NaN is skipped."""
    best = F.min(F.when(~F.isnan(v.cast("double")), F.struct(v.cast("double").alias("v"), (-pos).alias("p"))))
    return best["v"], -best["p"]


def argmax(v: Column, pos: Column) -> tuple[Column, Column]:
    """(value, position); of ties the first. NaN is skipped."""
    best = F.max(F.when(~F.isnan(v.cast("double")), F.struct(v.cast("double").alias("v"), (-pos).alias("p"))))
    return best["v"], -best["p"]


REDUCTIONS = {"sum": sum_, "product": product, "min": min_, "max": max_, "count": count, "all_true": all_true, "any_true": any_true}


def reduce(df: DataFrame, value: str, ops: Sequence[str], by: Sequence[str] = (), nanval: float | None = None) -> DataFrame:
    """Columns `by`, then one named after each of ops. nanval replaces NaN in sums and products."""
    v = F.col(value)
    f = REDUCTIONS | {"sum": lambda v, _: sum_whole(v)} if dict(df.dtypes).get(value) == "bigint" else REDUCTIONS
    columns = [(f[op](v, nanval) if op in ("sum", "product") else f[op](v)).alias(op) for op in ops]
    return df.groupBy(*by).agg(*columns)


def arg_reduce(df: DataFrame, value: str, position: str, op: str, by: Sequence[str] = ()) -> DataFrame:
    """Columns `by`, then value and index of the smallest or largest element ("min", "max")."""
    v, p = (argmin if op == "min" else argmax)(F.col(value), F.col(position))
    return df.groupBy(*by).agg(v.alias("value"), p.alias("index"))


def in_blocks(df: DataFrame, order: Sequence[str]) -> bool:
    """Whether a series without lanes is ordered by one whole number, so that it can be cut into blocks."""
    return len(order) == 1 and dict(df.dtypes).get(order[0]) in WHOLE


def in_block(df: DataFrame, position: str, block: int) -> DataFrame:
    """df with the number of the block that a row's position lies in; rows without one have a block of their own, the first."""
    return df.withColumn("__block", F.coalesce(F.floor(F.col(position) / block), F.lit(-(1 << 62))))


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b on columns of which NULLs are equal; these come once, as a has them."""
    b = b.withColumnsRenamed({c: f"__right_{c}" for c in on})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__right_{c}`")) for c in on]
    return a.join(b, same, how).drop(*[f"__right_{c}" for c in on])


def _long_runs(df: DataFrame, key: str, position: str, name: str, block: int = 1 << 20) -> DataFrame:
    df = in_block(df, position, block)
    w = Window.partitionBy("__block").orderBy(position)
    at = F.struct(position, F.col(key).alias("k"))  # a tie of positions, NULLs among them, is in order of key
    inner = F.when(F.lag(F.lit(1)).over(w).isNull() | F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    df = df.withColumn("__new", inner)
    ends = df.groupBy("__block").agg(F.min(at)["k"].alias("first"), F.max(at)["k"].alias("last"), F.sum("__new").alias("n"))
    blocks = Window.orderBy("__block")
    differs = F.when(F.lag(F.lit(1)).over(blocks).isNull() | F.lag("last").over(blocks).eqNullSafe(F.col("first")), 0).otherwise(1)
    ends = ends.withColumn("differs", differs).select("__block", (F.sum(F.col("n") + F.col("differs")).over(blocks) - F.col("n")).alias("__before"))
    return df.join(ends, "__block").withColumn(name, F.col("__before") + F.sum("__new").over(w)).drop("__block", "__new", "__before")


def runs(df: DataFrame, key: str, order: Sequence[str], by: Sequence[str] = (), name: str = "run") -> DataFrame:
    """df with the number of the run of consecutive equal keys that a row lies in, from 0 in each lane.

    One shuffle by lane, which is sorted in one task; a series without lanes that is ordered by one whole number goes in blocks
    of that number, of which only the first and last keys and the counts of runs meet.
    """
    if not by and in_blocks(df, order):
        return _long_runs(df, key, order[0], name)
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(F.lit(1)).over(w).isNotNull() & F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn(name, F.sum(changed).over(w) - 1)


#: Rows that a shuffled task takes, about, if lanes are small.
SHARE = 1 << 19


def spread(df: DataFrame, share: int | None = None) -> int:
    """Tasks for a shuffle of df, so that one's share of the rows doesn't grow with them: the session's number or more."""
    share = SHARE if share is None else share
    return max(-(-df.count() // share), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def reduce_by_key(df: DataFrame, key: str, value: str, order: Sequence[str], ops: Sequence[str], by: Sequence[str] = (), nanval: float | None = None) -> DataFrame:
    """A row per lane and run of consecutive equal keys: `by`, run, the key, then one column an op."""
    if by:  # the window and both steps of the aggregate share this shuffle; each holds its task's rows
        df = df.repartition(spread(df), *by)
    return reduce(runs(df, key, order, by), value, ops, [*by, "run", key], nanval)


def max_ragged(df: DataFrame, value: str, position: str, lengths: DataFrame, length: str, by: Sequence[str]) -> DataFrame:
    """Value and index of the largest of the first `length` elements of each lane; lengths has `by` and length."""
    return arg_reduce(null_safe_join(df, lengths, by).where(F.col(position) < F.col(length)), value, position, "max", by)
