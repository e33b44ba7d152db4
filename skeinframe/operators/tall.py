"""Factorizations of a tall table of vectors: rows over tasks, k components each, and nothing larger than k x k meets.

Each task brings its rows down to one triangular factor, by Householder reflections of a factor stacked on some rows at a time; factors
are combined FAN at a time, over rounds of tasks. The table's rows are read again only where the result has a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.operators.dense import ship

#: Rows stacked on a factor; factors combined by a task.
ROWS, FAN = 2048, 16


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    sizes = pc.list_value_length(column)
    if column.null_count or pc.any(pc.not_equal(sizes, k)).as_py():
        raise ValueError(f"every row needs {k} components")
    return pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, k)


def _down(x: np.ndarray, k: int) -> np.ndarray:
    """The k x k triangular factor of x, its diagonal not negative."""
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return sign[:, None] * r


def factor(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """R of the table's QR factorization: k x k, upper triangular, with a diagonal that isn't negative. An empty table gives zeros.

    A null component is zero; a null vector, or one without k components, raises an error.
    """
    ship(df.sparkSession)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = None, [], 0
        for batch in batches:
            held.append(_matrix(batch.column(0), k))
            n += len(held[-1])
            if n >= ROWS:
                r, held, n = _down(np.vstack([*([] if r is None else [r]), *held]), k), [], 0
        if held:
            r = _down(np.vstack([*([] if r is None else [r]), *held]), k)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], ["v"])

    rows = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    parts = rows.rdd.getNumPartitions()
    factors = rows.mapInArrow(reduced, "v array<double>")
    while parts > FAN:
        # successive parts, so that nothing but factors moves, and a task takes whole ones
        parts = -(-parts // FAN)
        factors = factors.withColumn("part", F.floor(F.spark_partition_id() / FAN)).repartition(parts, "part").select("v").mapInArrow(reduced, "v array<double>")
    top = [r[0] for r in factors.collect()]  # at most FAN factors of k rows
    return _down(np.array(top), k) if top else np.zeros((k, k))


def _product(df: DataFrame, vector: str, k: int, right: np.ndarray, name: str) -> DataFrame:
    """df with `name`: each row's vector times a k x m matrix."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != name]
    kinds = dict(df.dtypes)
    held = df.sparkSession.sparkContext.broadcast(right)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(len(keep)), k) @ held.value
            offsets = pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32)[: len(y) + 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], [*keep, name])

    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    return chosen.mapInArrow(multiplied, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` array<double>"]))


def _inverse(r: np.ndarray) -> np.ndarray:
    if (np.abs(np.diag(r)) <= np.abs(r).max(initial=0.0) * len(r) * np.finfo(float).eps).any():
        raise ValueError("the columns are dependent: use svd()")
    return np.linalg.solve(r, np.eye(len(r)))


def qr(df: DataFrame, vector: str, k: int, name: str = "q") -> tuple[DataFrame, np.ndarray]:
    """(df with each row of Q, R). Q comes from R's inverse twice over, which keeps its columns orthogonal; dependent columns raise an error."""
    first = factor(df, vector, k)
    inverse = _inverse(first)
    second = factor(_product(df.select(vector), vector, k, inverse, "__q"), "__q", k)
    return _product(df, vector, k, inverse @ _inverse(second), name), second @ first


def singular_values(df: DataFrame, vector: str, k: int) -> np.ndarray:
    return np.linalg.svd(factor(df, vector, k), compute_uv=False)


def svd(df: DataFrame, vector: str, k: int, name: str = "u", tolerance: float | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with each row of U, s, V^T) with as many components as the rank: singular values above tolerance times the largest."""
    _, s, vt = np.linalg.svd(factor(df, vector, k))
    keep = s > s.max(initial=0.0) * (k * np.finfo(float).eps if tolerance is None else tolerance)
    s, vt = s[keep], vt[keep]
    return _product(df, vector, k, vt.T / s, name), s, vt


def rank(df: DataFrame, vector: str, k: int, tolerance: float = 1e-5) -> int:
    """Diagonal elements of R beyond tolerance in size."""
    return int((np.abs(np.diag(factor(df, vector, k))) > tolerance).sum())


def pinverse(df: DataFrame, vector: str, k: int, name: str = "p", tolerance: float = 1e-6) -> DataFrame:
    """df with each row's column of the pseudoinverse: V s^-1 times its row of U, singular values up to tolerance times the largest left out."""
    _, s, vt = np.linalg.svd(factor(df, vector, k))
    keep = s > s.max(initial=0.0) * tolerance
    s, vt = s[keep], vt[keep]
    return _product(df, vector, k, (vt.T / s**2) @ vt, name)


def solve(df: DataFrame, vector: str, k: int, target: str) -> np.ndarray:
    """The least-squares solution of the rows' vectors against column target: k numbers."""
    with_target = df.select(F.concat(F.col(f"`{vector}`").cast("array<double>"), F.array(F.col(f"`{target}`").cast("double"))).alias("v"))
    r = factor(with_target, "v", k + 1)
    return _inverse(r[:k, :k]) @ r[:k, k]
