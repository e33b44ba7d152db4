"""Nearest neighbours of a query set among all rows, exact, without meeting every row.

Rows are dealt once to the cell of their nearest pivot and written in order of cell and distance to it. By the triangle inequality
a query is at least as far from all rows of a chunk as its own distance to a pivot lies outside theirs; chunks beyond the k-th distance
that a query already has aren't compared with it. A sample of rows gives every query such a distance from the start. Pivots and sample
only decide how much is left out, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.operators.dense import ship
from skeinframe.operators.neighbours import BLOCK, distances
from skeinframe.storage import settle

#: Pivots and sampled rows of each length of vectors; rows that are compared or left out together.
PIVOTS, SAMPLE, CHUNK = 32, 512, 256
#: Stands where a query has fewer than k rows yet.
_NONE = np.iinfo(np.int64).min


def _metric(d: np.ndarray, metric: str) -> np.ndarray:
    """A distance that keeps the triangle inequality."""
    return np.sqrt(d) if metric == "ssd" else d


def _apart(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """distances(), a bounded number of elements at a time."""
    step = max(1, (1 << 22) // max(1, t.size))
    return np.concatenate([distances(q[s : s + step], t, metric) for s in range(0, len(q), step)]) if len(q) else np.zeros((0, len(t)))


def _pivots(sample: np.ndarray, metric: str) -> np.ndarray:
    """Vectors of a sample that are far from one another: each next one is the farthest from those before."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not len(sample):
        return sample
    picked, least = [0], _apart(sample, sample[:1], metric)[:, 0]
    while len(picked) < PIVOTS and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, _apart(sample, sample[picked[-1:]], metric)[:, 0])
    return sample[picked]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), n)


def pruned_neighbours(query: DataFrame, train: DataFrame, k: int = 1, metric: str = "ssd", query_id: str = "id", train_id: str = "id", vector: str = "v", compared: Accumulator | None = None) -> DataFrame:
    """The rows of neighbours.nearest_neighbours: query_id, rank, train_id, distance; ties by train_id.

    compared: counts the pairs whose distance was taken, those with pivots among them. Queries pass through the driver in
    blocks of BLOCK; the sample and the pivots are of each length of vectors, of which there should be few.
    """
    spark = train.sparkSession
    ship(spark)
    queries = query.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").persist()
    rows = train.select(F.col(train_id).cast("long").alias("t"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").withColumn("n", F.size("v"))
    first = F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("t", "v")))
    sampled = rows.withColumn("__first", first).where(F.col("__first") <= SAMPLE).select("n", "v").toArrow()
    samples = {}
    for n in pc.unique(sampled.column("n")).to_pylist():
        samples[n] = _matrix(sampled.filter(pc.equal(sampled.column("n"), n)).column("v").combine_chunks(), n)
    pivots = spark.sparkContext.broadcast({n: _pivots(s, metric) for n, s in samples.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for n in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == n))
                centres = pivots.value[n]
                cell, r = np.zeros(mine.num_rows, np.int64), np.full(mine.num_rows, np.nan)
                if len(centres):
                    d = np.nan_to_num(_apart(_matrix(mine.column(1), n), centres, metric), nan=np.inf)
                    cell, r = d.argmin(axis=1), d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(cell), pa.array(r)], ["t", "v", "n", "cell", "r"])

    dealt = settle(rows.mapInArrow(deal, "t long, v array<double>, n int, cell long, r double").repartitionByRange("n", "cell", "r").sortWithinPartitions("n", "cell", "r"), "cells")
    blocks, out = max(1, -(-queries.count() // BLOCK)), None
    for b in range(blocks):
        part = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toArrow()
        lengths = pc.list_value_length(part.column("v")).to_numpy()
        held = {}
        for n in np.unique(lengths).tolist():
            if n not in samples:
                continue
            mine = part.filter(pa.array(lengths == n))
            values = _matrix(mine.column("v").combine_chunks(), n)
            near = np.sort(_apart(values, samples[n], metric), axis=1)
            bound = near[:, k - 1] if near.shape[1] >= k else np.full(len(values), np.inf)
            held[n] = mine.column("q").to_numpy(), values, _metric(_apart(values, pivots.value[n], metric), metric), bound
        sent = spark.sparkContext.broadcast(held)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = {n: [np.full((len(x[0]), k), np.inf), np.full((len(x[0]), k), _NONE)] for n, x in sent.value.items()}
            bounds = {n: x[3].copy() for n, x in sent.value.items()}
            count = 0
            for batch in batches:
                sizes = batch.column(2).to_numpy()
                for n in np.unique(sizes).tolist():
                    if n not in sent.value:
                        continue
                    mine = batch.filter(pa.array(sizes == n))
                    ids, values, to_pivots, _ = sent.value[n]
                    names, data, centres = mine.column(0).to_numpy(), _matrix(mine.column(1), n), pivots.value[n]
                    for s in range(0, len(names), CHUNK):
                        chunk, t = data[s : s + CHUNK], names[s : s + CHUNK]
                        going = np.arange(len(ids))
                        if len(centres):
                            r = _metric(_apart(chunk, centres, metric), metric)
                            count += r.size
                            # a chunk with a NaN has NaN here, and none of it is left out
                            least = np.maximum(to_pivots - r.max(axis=0), r.min(axis=0) - to_pivots).max(axis=1)
                            going = np.flatnonzero(~(least > _metric(bounds[n], metric) * (1 + 1e-9) + 1e-9))
                        if not len(going):
                            continue
                        count += len(going) * len(t)
                        d, held_t = best[n]
                        both = np.concatenate([d[going], _apart(values[going], chunk, metric)], axis=1)
                        who = np.concatenate([held_t[going], np.broadcast_to(t, (len(going), len(t)))], axis=1)
                        # places not yet filled come after all rows, NaN distances too
                        order = np.lexsort((who, both, who == _NONE), axis=1)[:, :k]
                        d[going], held_t[going] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
                        kth = np.where(held_t[going, k - 1] == _NONE, np.inf, d[going, k - 1])
                        bounds[n][going] = np.fmin(bounds[n][going], kth)
            if compared is not None:
                compared.add(count)
            for n, (d, t) in best.items():
                some = t.ravel() != _NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sent.value[n][0], k)[some]), pa.array(t.ravel()[some]), pa.array(d.ravel()[some])], ["q", "t", "distance"])

        found = dealt.mapInArrow(work, "q long, t long, distance double")
        out = found if out is None else out.unionByName(found)
    queries.unpersist()
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "t")) - 1).where(F.col("rank") < k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("t").alias("train_id"), "distance")
