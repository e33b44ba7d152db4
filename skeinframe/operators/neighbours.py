"""Nearest neighbours of a query set among all rows.

Queries go to the executors in blocks of bounded size; every task compares its rows
with a block by numpy and keeps k a query, and the tasks' winners meet by query.
Rows are never paired as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.operators.dense import ship

#: Queries sent to the executors at a time.
BLOCK = 4096


def distances(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Queries by rows. metric: sad (sum of absolute differences), ssd (of squared ones), shd (differing bits of whole numbers)."""
    if metric == "ssd":
        return ((q[:, None, :] - t[None]) ** 2).sum(axis=2)
    if metric == "sad":
        return np.abs(q[:, None, :] - t[None]).sum(axis=2)
    if metric == "shd":
        return np.bitwise_count(q[:, None, :].astype(np.int64) ^ t[None].astype(np.int64)).sum(axis=2).astype(float)
    raise ValueError(f"no such metric: {metric}")


def nearest_neighbours(query: DataFrame, train: DataFrame, k: int = 1, metric: str = "ssd", query_id: str = "id", train_id: str = "id", vector: str = "v") -> DataFrame:
    """query_id, rank (from 0), train_id, distance: the k rows of train nearest each query; ties by train_id. Ids are whole numbers.

    A row is compared with the queries of its length; null vectors take no part, and a null component is at NaN distance, last.
    """
    spark = train.sparkSession
    ship(spark)
    numbered = query.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").persist()
    rows = train.select(F.col(train_id).cast("long").alias("t"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    blocks = max(1, -(-numbered.count() // BLOCK))
    out = None
    for b in range(blocks):
        part = (numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toArrow()
        if not part.num_rows and blocks > 1:
            continue
        # queries by length: vectors of another length than a query's aren't compared with it
        lengths = pc.list_value_length(part.column("v")).to_numpy()
        sets = []
        for n in np.unique(lengths).tolist():
            mine = part.filter(pa.array(lengths == n))
            sets.append((n, mine.column("q").to_numpy(), pc.list_flatten(mine.column("v")).to_numpy().reshape(mine.num_rows, n)))
        held = spark.sparkContext.broadcast(sets)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {n: (np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)) for n, ids, _ in held.value}
            for batch in batches:
                sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for n, ids, values in held.value:
                    mine = batch if (sizes == n).all() else batch.filter(pa.array(sizes == n))
                    names = mine.column(0).to_numpy()
                    data = mine.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), n)
                    step = max(1, (1 << 22) // max(1, values.size))
                    for s in range(0, len(names), step):
                        d = np.concatenate([best[n][0], distances(values, data[s : s + step], metric)], axis=1)
                        t = np.concatenate([best[n][1], np.broadcast_to(names[s : s + step], (len(ids), len(names[s : s + step])))], axis=1)
                        order = np.lexsort((t, d), axis=1)[:, :k]
                        best[n] = np.take_along_axis(d, order, 1), np.take_along_axis(t, order, 1)
            for n, ids, _ in held.value:
                d, t = best[n]
                if d.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, d.shape[1])), pa.array(t.ravel()), pa.array(d.ravel())], ["q", "t", "distance"])

        found = rows.mapInArrow(work, "q long, t long, distance double")
        out = found if out is None else out.unionByName(found)
    numbered.unpersist()
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "t")) - 1).where(F.col("rank") < k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("t").alias("train_id"), "distance")


def hamming_matcher(query: DataFrame, train: DataFrame, k: int = 1, **names: str) -> DataFrame:
    return nearest_neighbours(query, train, k, "shd", **names)
