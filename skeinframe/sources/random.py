"""Random tensors and columns whose values don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skeinframe.functions.kernels import counter_rng
from skeinframe.operators.dense import ship
from skeinframe.operators.tensor import Tensor, coordinates, full


@dataclass
class RandomEngine:
    """kind: philox, threefry, mersenne, or hash (draws from xxhash64 inside the JVM: fastest, the values differ). Each draw moves the counter on."""

    kind: str = "philox"
    seed: int = 0
    counter: int = 0

    def set_type(self, kind: str) -> None:
        if kind not in ("philox", "threefry", "mersenne", "hash"):
            raise ValueError(f"no such engine: {kind}")
        self.kind = kind

    def set_seed(self, seed: int) -> None:
        self.seed, self.counter = seed, 0

    def _rows(self, spark: SparkSession, dims: Sequence[int], normal: bool) -> Tensor:
        dims = full(dims)
        first, n = self.counter, prod(dims)
        self.counter += n
        rows = spark.range(n)
        if self.kind == "hash":
            u = hashed_uniform(F.col("id") + first, self.seed)
            v = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * hashed_uniform(F.col("id") + first, ~self.seed)) if normal else u
            return Tensor(rows.select(*coordinates(F.col("id"), dims), v.alias("v")), dims)
        ship(spark)
        draw, kind, seed = (counter_rng.normal if normal else counter_rng.uniform), self.kind, self.seed

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(draw(batch.column(0).to_numpy() + first, seed, kind))], ["id", "v"])

        return Tensor(rows.mapInArrow(work, "id long, v double").select(*coordinates(F.col("id"), dims), "v"), dims)

    def uniform(self, spark: SparkSession, dims: Sequence[int]) -> Tensor:
        """In (0, 1]."""
        return self._rows(spark, dims, False)

    def normal(self, spark: SparkSession, dims: Sequence[int]) -> Tensor:
        return self._rows(spark, dims, True)


def hashed_uniform(index: Column, seed: int) -> Column:
    """A column of doubles in (0, 1], a function of index and seed; whole-stage code."""
    bits = F.shiftrightunsigned(F.xxhash64(index, F.lit(seed)), 11)
    return 1.0 - bits.cast("double") / F.lit(float(1 << 53))


_default = RandomEngine()


def default_engine() -> RandomEngine:
    return _default


def randu(spark: SparkSession, *dims: int) -> Tensor:
    return _default.uniform(spark, dims)


def randn(spark: SparkSession, *dims: int) -> Tensor:
    return _default.normal(spark, dims)


def set_seed(seed: int) -> None:
    _default.set_seed(seed)


def get_seed() -> int:
    return _default.seed
