"""Dense arrays in rows: one array a row, worked on by numpy in Arrow batches.

For operators that are dense or iterative within one array (factorizations,
transforms, images): a column of type ARRAY holds an array's shape and its values
in column-major order. Rows are independent, so nothing is shuffled, and the unit
of parallelism is the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.operators.tensor import COORDS, Tensor, linear

ARRAY = "struct<dims: array<int>, re: array<double>, im: array<double>>"
_TYPE = pa.struct([("dims", pa.list_(pa.int32())), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])
#: Tasks, at least, that search for keypoints: milliseconds an array.
PARTS = 96
FEATURES = "x double, y double, score double, orientation double, size double, descriptor array<double>"


def encode(a: np.ndarray | float | None) -> dict | None:
    if a is None:
        return None
    a = np.asarray(a)
    flat = a.ravel(order="F")
    return {"dims": list(a.shape) or [1], "re": flat.real.astype(np.float64), "im": flat.imag.astype(np.float64) if np.iscomplexobj(a) else None}


def decode(row: dict | None) -> np.ndarray | None:
    if row is None:
        return None
    v = np.asarray(row["re"], np.float64)
    if row["im"] is not None:
        v = v + 1j * np.asarray(row["im"], np.float64)
    return v.reshape(row["dims"], order="F")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session."""
    import os
    import tempfile
    import zipfile

    import skeinframe

    sc = spark.sparkContext
    if getattr(skeinframe, "_shipped", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(skeinframe.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skeinframe-"), "skeinframe_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("skeinframe", os.path.relpath(full, root)))
    sc.addPyFile(path)
    skeinframe._shipped = sc.applicationId


def host(spark: SparkSession, arrays: Sequence[np.ndarray], name: str = "a") -> DataFrame:
    """(id, name) from driver arrays."""
    rows = [(i, (list(map(int, e["dims"])), e["re"].tolist(), None if e["im"] is None else e["im"].tolist())) for i, e in enumerate(map(encode, arrays))]
    return spark.createDataFrame(rows, f"id long, {name} {ARRAY}")


def collect(df: DataFrame, name: str = "a", key: str = "id") -> list[np.ndarray]:
    return [decode(r[name].asDict()) for r in df.select(key, name).orderBy(key).collect()]


def from_tensor(t: Tensor, name: str = "a") -> DataFrame:
    """(id, name): a row per (d2, d3) slice, gathered by slice. Slices must fit in a task."""
    n0, n1, n2, _ = t.dims
    cells = t.df.select((F.col("d2") + n2 * F.col("d3")).alias("id"), F.struct(linear((n0, n1), [F.col(c) if c in COORDS[:2] else F.lit(0) for c in COORDS]).alias("i"), F.col("v").cast("double").alias("v")).alias("c"))
    rows = cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("re"))
    return rows.select("id", F.struct(F.array(F.lit(n0), F.lit(n1)).alias("dims"), "re", F.lit(None).cast("array<double>").alias("im")).alias(name))


def to_tensor(df: DataFrame, dims: Sequence[int], name: str = "a", key: str = "id") -> Tensor:
    """A tensor whose d2 is the key, from rows of real matrices of shape dims."""
    n0 = dims[0]
    cells = df.select(F.col(key).alias("d2"), F.posexplode(f"{name}.re").alias("i", "v"))
    return Tensor.of(cells.select((F.col("i") % n0).alias("d0"), F.floor(F.col("i") / n0).alias("d1"), "d2", "v"), dims)


def apply(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], f: Callable[..., object]) -> DataFrame:
    """df with columns `outputs` added: f of the arrays in columns `inputs`. f gives one array, or a tuple of one per output; None is NULL.

    A row with a null input gets null outputs.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in outputs]
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(keep.index(c)) for c in inputs]
            made: list[list] = [[] for _ in outputs]
            for i in range(batch.num_rows):
                args = [decode(c[i].as_py()) for c in columns]
                got = (None,) * len(outputs) if any(a is None for a in args) else f(*args)
                for out, a in zip(made, got if isinstance(got, tuple) else (got,), strict=True):
                    out.append(encode(a))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(m, _TYPE) for m in made)], [*keep, *outputs])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` {ARRAY}" for c in outputs])
    return df.select(*keep).mapInArrow(work, schema)


def dealt(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df's rows dealt evenly, a batch a task or less: thousands of arrays are a small file, which one task would read and work on alone."""
    spark = df.sparkSession
    parts = max(PARTS, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts is None else parts
    return df.repartition(parts)


def features(df: DataFrame, source: str, f: Callable[[np.ndarray], Sequence[dict]], keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys and a row per keypoint that f finds: x, y, score, orientation, size, descriptor."""
    ship(df.sparkSession)
    names = ["x", "y", "score", "orientation", "size", "descriptor"]
    kinds = dict(df.dtypes)
    n = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                image = decode(batch.column(n)[i].as_py())
                found = list(f(image)) if image is not None else []
                if found:
                    arrays = [pa.array([x.get(k, 0.0) if k != "descriptor" else x.get(k) for x in found], pa.list_(pa.float64()) if k == "descriptor" else pa.float64()) for k in names]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array([i] * len(found))) for k in range(n)), *arrays], [*keys, *names])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys]) + ", " + FEATURES
    return dealt(df.select(*keys, source)).mapInArrow(work, schema)
