"""Products of large dense matrices by tiles of TILE x TILE elements.

Elements of a tile meet in one row, tiles go to every tile of the product that they take part in, and a task adds up the
products of SLAB tiles along the inner dimension. What it holds is three tiles, whatever the shapes; a long inner dimension
is spread over tasks, and only sums of slabs meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE, SLAB = 256, 16
_KEY = ["bi", "bj", "slab", "d2", "d3"]


def _tiles(df: DataFrame, row: str, column: str, outer: str, side: int, others: int, batch: Sequence[tuple[int, int]]) -> DataFrame:
    """The tiles of one operand, a row for each tile of the product: _KEY, bk, side, cells (i, j, v).

    outer: which of row and column stays in the product. others: tiles of the product along the other operand's outer
    dimension. batch: of d2 and d3 the size here and in the product; of size 1 here, tiles are repeated.
    """
    inner = column if outer == row else row
    cell = F.struct(*[F.pmod(F.col(c), F.lit(TILE)).cast("int").alias(n) for c, n in ((row, "i"), (column, "j"))], F.col("v").cast("double").alias("v"))
    tiles = df.groupBy(F.floor(F.col(outer) / TILE).alias("bo"), F.floor(F.col(inner) / TILE).alias("bk"), "d2", "d3").agg(F.collect_list(cell).alias("cells"))
    for name, (here, there) in zip(("d2", "d3"), batch, strict=True):
        if here != there:
            tiles = tiles.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(there - 1).cast("long"))))
    tiles = tiles.withColumn("bp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    bi, bj = ("bo", "bp") if side == 0 else ("bp", "bo")
    return tiles.select(F.col(bi).alias("bi"), F.col(bj).alias("bj"), F.floor(F.col("bk") / SLAB).alias("slab"), "d2", "d3", "bk", F.lit(side).alias("side"), "cells")


def _filled(cells: pa.ListScalar) -> np.ndarray:
    out = np.zeros((TILE, TILE))
    i, j, v = (cells.values.field(n) for n in ("i", "j", "v"))
    out[i.to_numpy(), j.to_numpy()] = np.where(v.is_null().to_numpy(zero_copy_only=False), 0.0, v.to_numpy(zero_copy_only=False))
    return out


def product(a: DataFrame, b: DataFrame, a_dims: Sequence[int], b_dims: Sequence[int]) -> DataFrame:
    """The product of matrices of long form (d0, d1, d2, d3, v), a row per element of it. NULLs count as zero."""
    from skeinframe.operators.dense import ship

    ship(a.sparkSession)
    m, n = a_dims[0], b_dims[1]
    depth = [max(x, y) for x, y in zip(a_dims[2:], b_dims[2:], strict=True)]
    left = _tiles(a, "d0", "d1", "d0", 0, -(-n // TILE), list(zip(a_dims[2:], depth, strict=True)))
    right = _tiles(b, "d0", "d1", "d1", 1, -(-m // TILE), list(zip(b_dims[2:], depth, strict=True)))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, held = None, None, (None, None)

        def summed() -> pa.RecordBatch:
            bi, bj, _, d2, d3 = now
            rows, columns = min(TILE, m - bi * TILE), min(TILE, n - bj * TILE)
            i, j = (x.ravel() for x in np.indices((rows, columns)))
            values = [i + bi * TILE, j + bj * TILE, np.full(len(i), d2), np.full(len(i), d3), total[:rows, :columns].ravel()]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in values], ["d0", "d1", "d2", "d3", "v"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)
            for at, (*key, bk, side) in enumerate(keys):
                if key != now:
                    if total is not None:
                        yield summed()
                    now, total, held = key, None, (None, None)
                tile = _filled(batch.column(7)[at])
                if side == 0:
                    held = bk, tile
                elif held[0] == bk:
                    total = held[1] @ tile + (0.0 if total is None else total)
        if total is not None:
            yield summed()

    met = left.unionByName(right).repartition(*_KEY).sortWithinPartitions(*_KEY, "bk", "side")
    sums = met.mapInArrow(multiplied, "d0 long, d1 long, d2 long, d3 long, v double")
    if a_dims[1] <= TILE * SLAB:
        return sums
    return sums.groupBy("d0", "d1", "d2", "d3").agg(F.sum("v").alias("v"))
