"""Prefix scans, differences and positions.

With lanes (`by`), a scan is one window: lanes are scanned in parallel. Without
lanes a window would put all rows in one task, so a series that is ordered by one
whole number goes to long_scan(), which works in blocks of the ordering column:
totals per block, a scan over the blocks' totals, and scans within the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.functions.elementwise import true
from skeinframe.operators.reduce import in_block, in_blocks, null_safe_join, runs

#: Of each operation the aggregate, its start value, and how two partial results combine.
OPS = {
    "add": (F.sum, 0.0, lambda a, b: a + b),
    "mul": (F.product, 1.0, lambda a, b: a * b),
    "min": (F.min, float("inf"), F.least),
    "max": (F.max, float("-inf"), F.greatest),
}


def scan(df: DataFrame, value: str, order: Sequence[str], op: str = "add", inclusive: bool = True, by: Sequence[str] = (), name: str = "scan") -> DataFrame:
    """df with the result of op over a lane's rows up to this one, or up to the one before (then the first has the start value)."""
    aggregate, start, _ = OPS[op]
    if not by and in_blocks(df, order):
        return long_scan(df, value, order[0], op, inclusive, name=name)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = aggregate(F.col(value)).over(w)
    return df.withColumn(name, out if inclusive else F.coalesce(out, F.lit(start)))


def accum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "accum") -> DataFrame:
    """Inclusive sums; booleans count."""
    if dict(df.dtypes)[value] == "boolean":
        df = df.withColumn(value, F.col(value).cast("int"))
    return scan(df, value, order, "add", True, by, name)


def scan_by_key(df: DataFrame, key: str, value: str, order: Sequence[str], op: str = "add", inclusive: bool = True, by: Sequence[str] = (), name: str = "scan") -> DataFrame:
    """A scan that starts anew where the key changes."""
    run = "__run"
    return scan(runs(df, key, order, by, run), value, order, op, inclusive, [*by, run], name).drop(run)


def long_scan(df: DataFrame, value: str, position: str, op: str = "add", inclusive: bool = True, block: int = 1 << 20, name: str = "scan") -> DataFrame:
    """A scan over all rows by an integer position, in blocks of `block` positions; only the blocks' totals meet in one task.

    Rows without a position are one block, which comes first.
    """
    aggregate, start, combine = OPS[op]
    df = in_block(df, position, block)
    totals = df.groupBy("__block").agg(aggregate(F.col(value)).alias("__total"))
    before = aggregate(F.col("__total")).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("__block", before.alias("__before"))
    w = Window.partitionBy("__block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = df.withColumn("__within", aggregate(F.col(value)).over(w)).join(totals, "__block")  # its NULL has a number
    # NULLs are left out, so either part may be missing
    a, b = F.col("__before"), F.col("__within")
    out = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))
    return within.withColumn(name, out if inclusive else F.coalesce(out, F.lit(start))).drop("__block", "__before", "__within")


def where(df: DataFrame, value: str, index: Column) -> DataFrame:
    """Linear indices of the elements that aren't zero, ascending."""
    return df.where(true(F.col(value))).select(index.cast("long").alias("idx")).orderBy("idx")


def diff1(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "diff") -> DataFrame:
    """x[i+1] - x[i]; a lane's last row goes."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__next", F.lead(value).over(w)).withColumn("__more", F.lead(F.lit(1)).over(w)).where("__more is not null").withColumn(name, F.col("__next") - F.col(value)).drop("__next", "__more")


def diff2(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "diff") -> DataFrame:
    """x[i+2] - 2 x[i+1] + x[i]; a lane's last two rows go."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("__a", F.lead(value, 1).over(w)).withColumn("__b", F.lead(value, 2).over(w)).withColumn("__more", F.lead(F.lit(1), 2).over(w)).where("__more is not null")
    return out.withColumn(name, F.col("__b") - 2 * F.col("__a") + F.col(value)).drop("__a", "__b", "__more")


def shift(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], by_rows: int, name: str = "shifted") -> DataFrame:
    """A lane's values moved forward by by_rows, around its end."""
    lane = Window.partitionBy(*by)
    numbered = df.withColumn("__i", F.row_number().over(lane.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(lane))
    moved = numbered.select(*by, F.pmod(F.col("__i") + by_rows, F.col("__n")).alias("__i"), F.col(value).alias(name))
    return null_safe_join(numbered, moved, [*by, "__i"]).drop("__i", "__n")
