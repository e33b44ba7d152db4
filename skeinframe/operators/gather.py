"""Joins of a tensor's elements with index tables, for gathering and scattering.

Indices are columns, however many there are. A small table of them goes to every executor. Beyond that size the join
is by index, and neither an index that many places name nor a dimension with many lanes gathers in a task: places of a hot
index are dealt into parts and lanes into slices, both of PART rows, so that a task's share of the result is PART x PART at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of one index, and lanes of one position, that stay together.
PART = 1 << 16
#: Rows of a table that is sent to every executor.
SMALL = 1 << 20


def meet(cells: DataFrame, index: DataFrame, at: str, places: int, lanes: int, unique: bool = False, small: int | None = None, part: int | None = None) -> DataFrame:
    """cells and index joined on column at: rows of cells for each of the `places` rows of index.

    lanes: how many rows of cells a value of at can have. unique: index names no value twice. A hot index's elements are
    repeated once for every PART of the places that name it: fewer rows than the result has by that factor.
    """
    small, part = SMALL if small is None else small, PART if part is None else part
    if places <= small:
        return cells.join(F.broadcast(index), at)
    slices = max(1, -(-lanes // part))
    on = [at]
    if not unique:
        hot = index.groupBy(at).count().where(F.col("count") > part).select(at, F.ceil(F.col("count") / part).alias("__parts"))
        if places // part <= small:  # there can't be more hot ones than that
            hot = F.broadcast(hot)
        parts = F.coalesce("__parts", F.lit(1))
        index = index.join(hot, at, "left").withColumn("__part", F.pmod(F.xxhash64(*index.columns), parts)).drop("__parts")
        cells = cells.join(hot, at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
        on.append("__part")
    if slices > 1:
        others = [c for c in cells.columns if c not in (at, "v", "__part")]
        cells = cells.withColumn("__slice", F.pmod(F.xxhash64(*others), F.lit(slices)))
        index = index.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        on.append("__slice")
    return cells.join(index, on).drop("__part", "__slice")
