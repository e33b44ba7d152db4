"""Running operators over streams: windowed statistics, running sums, and recursive filters with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinframe.operators.dense import ship


def windowed(events: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """count, sum, mean, min, max of value per window and key. Rows later than `late` behind the newest are left out, in streams."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), *by)
    v = F.col(value)
    out = out.agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "sum", "mean", "min", "max")


def sessions(events: DataFrame, time: str, value: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key that end after a gap: start, end, n, sum."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "sum")


def running_filter(events: DataFrame, key: str, order: str, value: str, b: list[float], a: list[float]) -> DataFrame:
    """y of the recursive filter b / a along each key's rows, with its state kept between batches: key, order (long), x, y.

    Rows of a batch are filtered by order; batches follow each other as they come.
    """
    ship(events.sparkSession)
    kind = dict(events.dtypes)[key]
    nb, na = len(b), len(a)

    def work(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past_x, past_y = map(list, state.get) if state.exists else ([0.0] * (nb - 1), [0.0] * (na - 1))
        rows = pd.concat(list(frames)).sort_values("o")
        out = []
        for x in rows["x"]:
            y = (b[0] * x + sum(c * p for c, p in zip(b[1:], past_x)) - sum(c * p for c, p in zip(a[1:], past_y))) / a[0]
            past_x, past_y = [x, *past_x][: nb - 1], [y, *past_y][: na - 1]
            out.append(y)
        state.update((past_x, past_y))
        yield pd.DataFrame({key: group[0], "o": rows["o"].values, "x": rows["x"].values, "y": out})

    rows = events.select(key, F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("x"))
    return rows.groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, o long, x double, y double", "px array<double>, py array<double>", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("o", order)
