"""Sorting, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinframe.operators.reduce import null_safe_join
from skeinframe.storage import settle


def _by(column: str, ascending: bool):
    return F.col(column).asc() if ascending else F.col(column).desc()


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with each row's place from 0 in the order over all rows, without bringing them into one task.

    Rows are dealt by ranges of the order's columns and sorted within a range, once; the written table keeps each row's range and
    place in it, and only the counts of the ranges meet. Rows that share a value are told apart by the order's later columns, so
    give it one that differs, such as the position: then a value that many rows share is spread over ranges, too. Rows that agree in
    all columns of the order get successive places in any order. ranges: how many; else Spark's choice.
    """
    at = fresh(df, "__at")
    dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    ranges = settle(dealt.sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    # the id is the partition's number, then 33 bits of the row's place in it
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    offsets, before = [], 0
    for number, n in sorted(ranges.groupBy(part.alias("part")).count().collect()):  # a row a partition
        offsets.append((number, before))
        before += n
    offset = fresh(df, "__offset")
    table = df.sparkSession.createDataFrame(offsets, f"__part long, `{offset}` long")
    met = ranges.join(F.broadcast(table), part == F.col("__part"))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(f"`{offset}`") + place).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a lane up to which one task ranks them.
LANE = 1 << 20


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str], name: str, lane: int | None = None) -> DataFrame:
    """df with each row's place from 0 in its lane.

    Lanes of up to `lane` rows go by a window, a lane a task. The rows of all larger ones are numbered together, lane after lane, by
    numbered(), and a lane's numbers start where those before it end: there are at most rows / lane of them, which the driver sees.
    """
    if not by:
        return numbered(df, order, name)
    lane = LANE if lane is None else lane
    small = lambda rows: rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    size, start = fresh(df, "__size"), fresh(df, "__start")
    sizes = df.groupBy(*by).agg(F.count("*").alias(size)).where(F.col(size) > lane)
    found = sizes.withColumn(start, F.sum(size).over(Window.orderBy(*by)) - F.col(size)).collect()
    if not found:
        return small(df)
    large = [(*r[: len(by)], r[start]) for r in found]
    ranges = max(sum(r[size] for r in found) // lane + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType for f in df.schema}
    lanes = F.broadcast(df.sparkSession.createDataFrame(large, T.StructType([*(T.StructField(c, kinds[c]) for c in by), T.StructField(start, T.LongType())])))
    # equal rows of an order that leaves them open are spread over ranges, too
    tie = fresh(df, "__tie")
    rows = null_safe_join(df, lanes, by).withColumn(tie, F.monotonically_increasing_id())
    placed = numbered(rows, [*(F.col(f"`{c}`").asc() for c in by), *order, F.col(tie).asc()], name, ranges)
    placed = placed.withColumn(name, F.col(f"`{name}`") - F.col(start)).drop(start, tie)
    return small(null_safe_join(df, lanes.drop(start), by, "left_anti")).unionByName(placed)


def sort(df: DataFrame, value: str, ascending: bool = True, by: Sequence[str] = (), name: str = "rank", lane: int | None = None) -> DataFrame:
    """Each lane's values with their place (from 0) in order, see ranked(). Without lanes: a range-partitioned total order, no places."""
    if not by:
        return df.orderBy(_by(value, ascending))
    return ranked(df, [_by(value, ascending)], by, name, lane)


def sort_index(df: DataFrame, value: str, position: str, ascending: bool = True, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Stable: equal values keep the order of their positions. Columns by, rank, value, index.

    Spark's order: NULL is the smallest, NaN the largest value. Without lanes the ranks are distributed, see numbered().
    """
    rows = df.select(*by, F.col(value).alias("value"), F.col(position).alias("index"))
    return ranked(rows, [_by("value", ascending), F.col("index").asc()], by, name).select(*by, name, "value", "index")


def sort_by_key(df: DataFrame, key: str, value: str, position: str, ascending: bool = True, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Keys in order, values along with them, equal keys in order of position. Columns by, rank, key, value. Without lanes as sort_index."""
    rows = df.select(*by, F.col(key).alias("key"), F.col(value).alias("value"), F.col(position).alias("__position"))
    return ranked(rows, [_by("key", ascending), F.col("__position").asc()], by, name).select(*by, name, "key", "value")


def topk(df: DataFrame, value: str, position: str, k: int, largest: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The k largest or smallest of each lane, ties by position: by, rank, value, index.

    Spark keeps k rows a lane and task before the shuffle.
    """
    order = [_by(value, not largest), F.col(position).asc()]
    w = Window.partitionBy(*by).orderBy(*order)
    if not by:
        df = df.select(value, position).orderBy(*order).limit(k)
    ranked = df.select(*by, F.row_number().over(w).alias("rank"), F.col(value).alias("value"), F.col(position).alias("index"))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def set_unique(df: DataFrame, value: str) -> DataFrame:
    return df.select(value).distinct().orderBy(value)


def set_union(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    return a.select(value).union(b.select(value)).distinct().orderBy(value)


def set_intersect(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    return a.select(value).intersect(b.select(value)).orderBy(value)


def array_sort(column: str, ascending: bool = True):
    """In-row form: a lane is an array."""
    return F.sort_array(F.col(column), ascending)


def array_sort_index(column: str, ascending: bool = True):
    """In-row form of sort_index: an array of structs (value, index); stable."""
    pairs = F.transform(F.col(column), lambda x, i: F.struct((x if ascending else -x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct((p["k"] if ascending else -p["k"]).alias("value"), p["i"].alias("index")))
