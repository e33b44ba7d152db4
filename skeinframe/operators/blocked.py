"""Cholesky factors, systems and inverses of symmetric positive definite matrices that are tables, by tiles.

A matrix is a table of tiles (bi, bj, x): x has the tile's doubles, row by row. The factorization goes panel by panel: one tile
of the diagonal is factored, the tiles below it are solved against that factor where they are, and the rest of the matrix, written
out between steps, is updated by products of two tiles of the panel. Rows put below the matrix come out multiplied by the factor's inverse
transpose: right sides are solved along with it. The driver sees one tile a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.operators.tensor import Tensor
from skeinframe.storage import forget, settle

TILE = 256
#: Bytes of a panel up to which it is sent to every executor; a longer one is joined by shuffles.
SENT = 64 << 20
_SCHEMA = "bi long, bj long, x binary"


def _each(df: DataFrame, f: Callable[..., np.ndarray], width: int, columns: int = 1) -> DataFrame:
    """bi, bj, x: f of bi, bj and df's binary columns after them, as vectors of doubles or None."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bi, bj = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row in range(batch.num_rows):
                data = (batch.column(2 + c)[row] for c in range(columns))
                got = f(bi[row], bj[row], *(np.frombuffer(x.as_buffer()) if x.is_valid else None for x in data))
                yield pa.RecordBatch.from_arrays([pa.array([bi[row]]), pa.array([bj[row]]), pa.array([np.ascontiguousarray(got).tobytes()], pa.binary())], ["bi", "bj", "x"])

    return df.mapInArrow(work, _SCHEMA)


def tiles(t: Tensor, tile: int = TILE) -> DataFrame:
    """The tiles of t's matrix. NULL elements are NaN."""
    from skeinframe.operators.dense import ship

    ship(t.df.sparkSession)
    m, n = t.dims[:2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([part.tobytes()], pa.binary())], ["bi", "bj", "x"])

        for batch in batches:
            bi, bj, i, j, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            edges = [0, *(np.flatnonzero((np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1).tolist(), len(bi)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = int(bi[a]), int(bj[a])
                if key != now:
                    if part is not None:
                        yield done()
                    now, part = key, np.full((min(tile, m - key[0] * tile), min(tile, n - key[1] * tile)), np.nan)
                part[i[a:b] - key[0] * tile, j[a:b] - key[1] * tile] = v[a:b]
        if part is not None:
            yield done()

    cells = t.dense().df.select(F.floor(F.col("d0") / tile).alias("bi"), F.floor(F.col("d1") / tile).alias("bj"), "d0", "d1", F.col("v").cast("double").alias("v"))
    return cells.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(work, _SCHEMA)


def tensor(df: DataFrame, rows: int, columns: int, tile: int = TILE) -> Tensor:
    """The matrix of these tiles; tiles that aren't there are zero."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shape = min(tile, rows - bi * tile), min(tile, columns - bj * tile)
                i, j = (x.ravel() for x in np.indices(shape))
                yield pa.RecordBatch.from_arrays([pa.array(i + bi * tile), pa.array(j + bj * tile), pa.array(np.frombuffer(x.as_buffer()))], ["d0", "d1", "v"])

    return Tensor.of(df.select("bi", "bj", "x").mapInArrow(work, "d0 long, d1 long, v double"), [rows, columns], sparse=True)


def _factored(a: np.ndarray, before: int) -> np.ndarray:
    """The lower factor of a tile of the diagonal."""
    if not np.isfinite(a).all():
        raise ValueError("the matrix has an element that isn't a finite number")
    a = np.tril(a) + np.tril(a, -1).T
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        for k in range(1, len(a) + 1):
            try:
                np.linalg.cholesky(a[:k, :k])
            except np.linalg.LinAlgError:
                raise ValueError(f"not positive definite: the leading minor of order {before + k}") from None
        raise


def _beside(df: DataFrame, panel: DataFrame, on: str, name: str, from_: str, sent: bool) -> DataFrame:
    """df with the tile of a panel that stands in its row or column as column name; NULL where there is none."""
    there = panel.select(F.col(from_).alias(on), F.col("x").alias(name))
    return df.join(F.broadcast(there) if sent else there, on, "left")


def _eliminate(work: DataFrame, n: int, tile: int, below: int = 0) -> DataFrame:
    """Tiles of the factor, from the lower tiles of an n x n matrix and of `below` more tiles of rows under it.

    Each step writes what is left of the matrix; steps that an executor's loss interrupts start from the last one written.
    """
    spark, blocks, panels = work.sparkSession, -(-n // tile), []
    work = settle(work, "cholesky")
    for k in range(blocks):
        width = min(tile, n - k * tile)
        x = work.where((F.col("bi") == k) & (F.col("bj") == k)).select("x").first()
        factor = _factored(np.frombuffer(x[0]).reshape(width, width), k * tile)
        solved = _each(work.where(f"bj = {k}"), lambda bi, bj, x, k=k, w=width, l=factor: l if bi == bj else np.linalg.solve(l, x.reshape(-1, w).T).T, width)
        panel = settle(solved, "cholesky-panel")
        panels.append(panel)
        if k + 1 < blocks:
            sent = (blocks + below - k) * tile * tile * 8 <= SENT
            pairs = _beside(work.where(f"bj > {k}"), panel.where(f"bi > {k}"), "bi", "l", "bi", sent)
            pairs = _beside(pairs, panel.where(f"bi > {k} AND bi < {blocks}"), "bj", "r", "bi", sent).select("bi", "bj", "x", "l", "r")
            left = settle(_each(pairs, lambda bi, bj, x, l, r, w=width: x if l is None or r is None else x - (l.reshape(-1, w) @ r.reshape(-1, w).T).ravel(), width, 3), "cholesky")
            forget(work)
            work = left
    forget(work)
    return spark.read.schema(_SCHEMA).parquet(*[p.settled_at for p in panels])


def _square(a: Tensor) -> int:
    if a.dims[0] != a.dims[1] or a.dims[2:] != (1, 1) or not a.dims[0]:
        raise ValueError(f"not a square matrix: {a.dims}")
    return a.dims[0]


def cholesky(a: Tensor, upper: bool = False, tile: int = TILE) -> Tensor:
    """L, lower, with a = L L^T, or L^T; of a the lower part is read. The result is sparse: tiles above the diagonal have no rows.

    A matrix that isn't positive definite raises ValueError with the order of the first leading minor at fault.
    """
    n = _square(a)
    out = tensor(_eliminate(tiles(a, tile).where("bi >= bj"), n, tile), n, n, tile)
    return out.transpose() if upper else out


def solve(a: Tensor, b: Tensor, tile: int = TILE) -> Tensor:
    """x of a x = b for a symmetric positive definite a and the columns of b: forward along with the factorization, then back by block columns."""
    n = _square(a)
    if b.dims[0] != n:
        raise ValueError(f"shapes {a.dims} and {b.dims} don't match")
    m, blocks = b.dims[1], -(-n // tile)
    right = tiles(b.transpose(), tile).withColumn("bi", F.col("bi") + blocks)
    factor = _eliminate(tiles(a, tile).where("bi >= bj").unionByName(right), n, tile, -(-m // tile))
    y = settle(factor.where(f"bi >= {blocks}").withColumn("bi", F.col("bi") - blocks), "solve")
    found = []
    for k in reversed(range(blocks)):
        w = min(tile, n - k * tile)
        diagonal = np.frombuffer(factor.where(f"bi = {k} AND bj = {k}").select("x").first()[0]).reshape(w, w)
        x = settle(_each(y.where(f"bj = {k}"), lambda bi, bj, x, w=w, l=diagonal: np.linalg.solve(l.T, x.reshape(-1, w).T).T, w), "solve-found")
        found.append(x)
        if k:
            row = factor.where(f"bi = {k} AND bj < {k}")
            pairs = _beside(_beside(y.where(f"bj < {k}"), x, "bi", "p", "bi", m * w * 8 <= SENT), row, "bj", "l", "bj", n * w * 8 <= SENT).select("bi", "bj", "x", "p", "l")
            left = settle(_each(pairs, lambda bi, bj, x, p, l, w=w: x - (p.reshape(-1, w) @ l.reshape(w, -1)).ravel(), w, 3), "solve")
            forget(y)
            y = left
    forget(y)
    out = a.df.sparkSession.read.schema(_SCHEMA).parquet(*[x.settled_at for x in found])
    return Tensor(tensor(out, m, n, tile).transpose().df, (n, m, 1, 1))


def inverse(a: Tensor, tile: int = TILE) -> Tensor:
    """Of a symmetric positive definite matrix: the identity under it becomes L^-T, whose product with its transpose is the inverse."""
    n = _square(a)
    blocks = -(-n // tile)
    spark = a.df.sparkSession
    lower = tiles(a, tile).where("bi >= bj")
    at = spark.range(blocks * blocks).select((F.col("id") % blocks).alias("bi"), F.floor(F.col("id") / blocks).alias("bj")).where("bi <= bj").withColumn("x", F.lit(b""))

    def unit(bi: int, bj: int, _) -> np.ndarray:
        shape = min(tile, n - bi * tile), min(tile, n - bj * tile)
        return np.eye(*shape) if bi == bj else np.zeros(shape)

    under = _each(at, unit, tile).withColumn("bi", F.col("bi") + blocks)
    factor = _eliminate(lower.unionByName(under), n, tile, blocks)
    z = tensor(factor.where(f"bi >= {blocks}").withColumn("bi", F.col("bi") - blocks), n, n, tile).dense()
    return z.matmul(z, trans_b=True)


def log_determinant(a: Tensor, tile: int = TILE) -> float:
    """Of a symmetric positive definite matrix."""
    return cholesky(a, tile=tile).df.where("d0 = d1").agg(F.sum(2 * F.log("v"))).first()[0]
