"""Tensors of up to four dimensions in long form: a row per element, (d0, d1, d2, d3, v).

Shapes are known on the driver, so reshaping is arithmetic on coordinates and
costs no shuffle. Linear indices are column-major: d0 + n0 * (d1 + n1 * (d2 + n2 * d3)).
A sparse tensor has rows for its non-zero elements alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinframe import dtypes
from skeinframe.functions import elementwise as E
from skeinframe.operators import reduce as R

COORDS = ("d0", "d1", "d2", "d3")
#: Elements up to which an operand is small enough to send to every executor.
BROADCAST_ELEMENTS = 1 << 20
#: Products of two elements up to which a dense matrix product is a join.
JOINED_PRODUCTS = 1 << 20


def full(dims: Sequence[int]) -> tuple[int, int, int, int]:
    if len(dims) > 4 or any(n < 0 for n in dims):
        raise ValueError(f"not a shape: {dims}")
    return (*map(int, dims), *[1] * (4 - len(dims)))  # type: ignore[return-value]


def linear(dims: Sequence[int], coords: Sequence[Column] | None = None) -> Column:
    """The column-major index of coordinates."""
    d = list(coords or map(F.col, COORDS))
    n = full(dims)
    return d[0] + n[0] * (d[1] + n[1] * (d[2] + n[2] * d[3]))


def coordinates(index: Column, dims: Sequence[int]) -> list[Column]:
    n, out, step = full(dims), [], 1
    for k in range(4):
        at = F.floor(index / step) if step > 1 else index
        out.append((at if k == 3 else F.pmod(at, F.lit(n[k]))).cast("long").alias(COORDS[k]) if n[k] else F.lit(0).cast("long").alias(COORDS[k]))
        step *= max(n[k], 1)
    return out


def reflect(index: Column, n: int) -> Column:
    """Indices that are out of range come back in from the end they left by; none is an error."""
    i = index.cast("long")
    return F.when(i < 0, F.pmod(F.abs(i) - 1, F.lit(n))).when(i >= n, n - 1 - F.pmod(i, F.lit(n))).otherwise(i)


def first_dim(dims: Sequence[int]) -> int:
    """The dimension that is reduced by default: the first of more than one element."""
    return next((k for k, n in enumerate(full(dims)) if n != 1), 0)


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[int, int, int, int]
    dtype: str = "f64"
    sparse: bool = False

    # making ----------------------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, dims: Sequence[int], dtype: str = "f64", sparse: bool = False) -> Tensor:
        have = set(df.columns)
        return Tensor(df.select(*[(F.col(c).cast("long") if c in have else F.lit(0).cast("long")).alias(c) for c in COORDS], F.col("v")), full(dims), dtype, sparse)

    @staticmethod
    def host(spark: SparkSession, values: Sequence, dims: Sequence[int] | None = None, dtype: str = "f64") -> Tensor:
        """From driver values in column-major order; for small arrays."""
        dims = full(dims or [len(values)])
        if math.prod(dims) != len(values):
            raise ValueError("the values don't fill the shape")
        kind = dtypes.SPARK[dtype]
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
        return Tensor(rows.select(*coordinates(F.col("i"), dims), "v"), dims, dtype)

    @staticmethod
    def grid(spark: SparkSession, dims: Sequence[int], value: Column | None = None, dtype: str = "f64") -> Tensor:
        """Every element's value from its linear index (column i) and coordinates."""
        dims = full(dims)
        rows = spark.range(math.prod(dims)).withColumnRenamed("id", "i").select("i", *coordinates(F.col("i"), dims))
        out = F.lit(0) if value is None else value
        return Tensor(rows.select(*COORDS, out.cast(dtypes.SPARK[dtype]).alias("v")), dims, dtype)

    @staticmethod
    def constant(spark: SparkSession, value, dims: Sequence[int], dtype: str = "f64") -> Tensor:
        if isinstance(value, complex):
            rows = Tensor.grid(spark, dims)
            return Tensor(rows.df.withColumn("v", E.cplx(value.real, value.imag)), rows.dims, "c64")
        return Tensor.grid(spark, dims, F.lit(value), dtype)

    @staticmethod
    def identity(spark: SparkSession, dims: Sequence[int], dtype: str = "f64") -> Tensor:
        return Tensor.grid(spark, dims, F.when(F.col("d0") == F.col("d1"), 1).otherwise(0), dtype)

    @staticmethod
    def range(spark: SparkSession, dims: Sequence[int], seq_dim: int = 0, dtype: str = "f64") -> Tensor:
        return Tensor.grid(spark, dims, F.col(COORDS[max(seq_dim, 0)]), dtype)

    @staticmethod
    def iota(spark: SparkSession, dims: Sequence[int], tiles: Sequence[int] = (1,), dtype: str = "f64") -> Tensor:
        """0, 1, ... over dims, then tiled."""
        return Tensor.grid(spark, dims, F.col("i"), dtype).tile(*tiles)

    # facts -----------------------------------------------------------------------

    @property
    def elements(self) -> int:
        return math.prod(self.dims)

    @property
    def ndims(self) -> int:
        return max((k + 1 for k, n in enumerate(self.dims) if n != 1), default=1) if self.elements else 0

    def is_empty(self) -> bool:
        return self.elements == 0

    def is_scalar(self) -> bool:
        return self.elements == 1

    def is_row(self) -> bool:
        return self.dims[0] == 1 and self.dims[1] > 1 and self.dims[2:] == (1, 1)

    def is_column(self) -> bool:
        return self.dims[0] > 1 and self.dims[1:] == (1, 1, 1)

    def is_vector(self) -> bool:
        return sum(n > 1 for n in self.dims) == 1

    def is_complex(self) -> bool:
        return dtypes.is_complex(self.dtype)

    def is_real(self) -> bool:
        return not self.is_complex()

    def is_double(self) -> bool:
        return self.dtype in ("f64", "c64")

    def is_single(self) -> bool:
        return self.dtype in ("f32", "c32")

    def is_half(self) -> bool:
        return self.dtype == "f16"

    def is_realfloating(self) -> bool:
        return self.dtype[0] == "f"

    def is_floating(self) -> bool:
        return dtypes.is_floating(self.dtype)

    def is_integer(self) -> bool:
        return dtypes.is_integer(self.dtype)

    def is_bool(self) -> bool:
        return self.dtype == "b8"

    def is_sparse(self) -> bool:
        return self.sparse

    def bytes(self) -> int:
        return self.elements * dtypes.SIZES[self.dtype]

    # to the host and evaluation -----------------------------------------------------------

    def ordered(self) -> DataFrame:
        return self.df.orderBy(linear(self.dims))

    def values(self) -> list:
        """All values in column-major order; for small results."""
        return [r["v"] for r in self.dense().ordered().collect()] if self.sparse else [r["v"] for r in self.ordered().collect()]

    def scalar(self):
        return self.df.where(linear(self.dims) == 0).first()["v"]

    def eval(self) -> Tensor:
        """Computed now and kept: with checkpoint() where the session has a checkpoint folder, else persisted."""
        spark = self.df.sparkSession
        if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
            return replace(self, df=self.df.checkpoint())
        kept = self.df.persist()
        kept.count()
        return replace(self, df=kept)

    def text(self, name: str = "") -> str:
        """A printable form, a row per d0; for small tensors."""
        v, n = self.values(), self.dims
        lines = [f"{name} [{' '.join(map(str, n))}]"]
        for s in range(n[2] * n[3]):
            lines += ["  ".join(str(v[s * n[0] * n[1] + j * n[0] + i]) for j in range(n[1])) for i in range(n[0])] + [""]
        return "\n".join(lines)

    # elementwise -------------------------------------------------------------------

    def map(self, f: Callable[[Column], Column], dtype: str | None = None) -> Tensor:
        return replace(self, df=self.df.withColumn("v", f(F.col("v"))), dtype=dtype or self.dtype)

    def cast(self, dtype: str) -> Tensor:
        return self.map(lambda v: dtypes.cast(v, self.dtype, dtype), dtype)

    def zip(self, other: Tensor, f: Callable[[Column, Column], Column], dtype: str | None = None) -> Tensor:
        """f of both, element by element; dimensions of one element are repeated. An equi-join on the others' coordinates."""
        dims = []
        for a, b in zip(self.dims, other.dims, strict=True):
            if a != b and 1 not in (a, b):
                raise ValueError(f"shapes {self.dims} and {other.dims} don't match")
            dims.append(max(a, b) if min(a, b) else 0)
        on = [c for c, a, b in zip(COORDS, self.dims, other.dims, strict=True) if a == b and a != 1]
        left = self.df.select([F.col(c).alias(f"l{c}") if c not in on else F.col(c) for c in COORDS] + [F.col("v").alias("lv")])
        right = other.df.select([F.col(c).alias(f"r{c}") if c not in on else F.col(c) for c in COORDS] + [F.col("v").alias("rv")])
        if other.elements <= BROADCAST_ELEMENTS and other.elements <= self.elements:
            right = F.broadcast(right)
        elif self.elements <= BROADCAST_ELEMENTS:
            left = F.broadcast(left)
        joined = left.join(right, on) if on else left.crossJoin(right)
        coords = [F.col(c) if c in on else F.col(f"l{c}" if a >= b else f"r{c}").alias(c) for c, a, b in zip(COORDS, self.dims, other.dims, strict=True)]
        return Tensor(joined.select(*coords, f(F.col("lv"), F.col("rv")).alias("v")), full(dims), dtype or dtypes.promote(self.dtype, other.dtype))

    def _op(self, other, f, dtype: str | None = None) -> Tensor:
        if not isinstance(other, Tensor):
            return self.map(lambda v: f(v, F.lit(other)), dtype)
        if self.sparse or other.sparse:
            return self.dense()._op(other.dense(), f, dtype)
        return self.zip(other, f, dtype)

    def __add__(self, o):
        return self._op(o, E.cadd if self.is_complex() else E.add)

    def __sub__(self, o):
        return self._op(o, E.csub if self.is_complex() else E.sub)

    def __mul__(self, o):
        if isinstance(o, Tensor) and self.sparse != o.sparse:
            # zero wherever the sparse operand has no row
            a, b = (self, o) if self.sparse else (o, self)
            return replace(a.zip(replace(b, sparse=False), E.mul), sparse=True)
        return self._op(o, E.cmul if self.is_complex() else E.mul)

    def __truediv__(self, o):
        return self._op(o, E.cdiv if self.is_complex() else E.div)

    def __floordiv__(self, o):
        return self._op(o, E.idiv)

    def __mod__(self, o):
        return self._op(o, E.mod)

    def __lt__(self, o):
        return self._op(o, E.lt, "b8")

    def __gt__(self, o):
        return self._op(o, E.gt, "b8")

    def __le__(self, o):
        return self._op(o, E.le, "b8")

    def __ge__(self, o):
        return self._op(o, E.ge, "b8")

    def eq(self, o):
        return self._op(o, E.eq, "b8")

    def neq(self, o):
        return self._op(o, E.neq, "b8")

    def __and__(self, o):
        return self._op(o, E.bitand if self.is_integer() else E.logical_and)

    def __or__(self, o):
        return self._op(o, E.bitor if self.is_integer() else E.logical_or)

    def __xor__(self, o):
        return self._op(o, E.bitxor)

    def __lshift__(self, bits: int):
        return self.map(lambda v: E.shiftl(v, bits))

    def __rshift__(self, bits: int):
        return self.map(lambda v: E.shiftr(v, bits, self.dtype[0] == "u"))

    def __neg__(self):
        return self.map(E.neg)

    def __invert__(self):
        return self.map(E.logical_not, "b8")

    # moving and reshaping ---------------------------------------------------------------

    def _moved(self, dims: Sequence[int], **coords: Column) -> Tensor:
        return replace(self, df=self.df.select(*[coords.get(c, F.col(c)).cast("long").alias(c) for c in COORDS], "v"), dims=full(dims))

    def moddims(self, *dims: int) -> Tensor:
        if math.prod(full(dims)) != self.elements:
            raise ValueError("a new shape must have as many elements")
        at = self.df.select(linear(self.dims).alias("i"), "v")
        return replace(self, df=at.select(*coordinates(F.col("i"), dims), "v"), dims=full(dims))

    def flat(self) -> Tensor:
        return self.moddims(self.elements)

    def reorder(self, *order: int) -> Tensor:
        """Dimension k of the result is dimension order[k]."""
        order = (*order, *[k for k in range(4) if k not in order])
        return self._moved([self.dims[k] for k in order], **{COORDS[i]: F.col(COORDS[k]) for i, k in enumerate(order)})

    def transpose(self, conjugate: bool = False) -> Tensor:
        out = self.reorder(1, 0)
        return out.map(E.conjg) if conjugate and self.is_complex() else out

    def shift(self, *by: int) -> Tensor:
        """Circular."""
        return self._moved(self.dims, **{COORDS[k]: F.pmod(F.col(COORDS[k]) + s, F.lit(self.dims[k])) for k, s in enumerate(by)})

    def flip(self, dim: int = 0) -> Tensor:
        return self._moved(self.dims, **{COORDS[dim]: self.dims[dim] - 1 - F.col(COORDS[dim])})

    def tile(self, *times: int) -> Tensor:
        out = self
        for k, t in enumerate(times):
            if t != 1:
                c, n = COORDS[k], out.dims[k]
                df = out.df.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn(c, F.col(c) + F.col("__t") * n).drop("__t")
                out = replace(out, df=df, dims=(*out.dims[:k], n * t, *out.dims[k + 1 :]))
        return out

    def join(self, dim: int, *others: Tensor) -> Tensor:
        """Concatenation along a dimension; empty operands are passed over."""
        parts = [t for t in (self, *others) if not t.is_empty()]
        if not parts:
            return self
        out, at = parts[0].df, parts[0].dims[dim]
        for t in parts[1:]:
            if any(a != b for k, (a, b) in enumerate(zip(parts[0].dims, t.dims, strict=True)) if k != dim):
                raise ValueError("shapes differ besides the dimension joined along")
            out = out.unionByName(t.df.withColumn(COORDS[dim], F.col(COORDS[dim]) + at))
            at += t.dims[dim]
        return replace(parts[0], df=out, dims=(*parts[0].dims[:dim], at, *parts[0].dims[dim + 1 :]))

    def lower(self, unit: bool = False) -> Tensor:
        return self._triangle(F.col("d0") >= F.col("d1"), unit)

    def upper(self, unit: bool = False) -> Tensor:
        return self._triangle(F.col("d0") <= F.col("d1"), unit)

    def _triangle(self, keep: Column, unit: bool) -> Tensor:
        v = F.when(keep, F.col("v")).otherwise(F.lit(0))
        if unit:
            v = F.when(F.col("d0") == F.col("d1"), F.lit(1)).otherwise(v)
        return replace(self, df=self.df.withColumn("v", v.cast(dtypes.SPARK[self.dtype])))

    def diag_create(self, num: int = 0) -> Tensor:
        n = self.dims[0] + abs(num)
        at = replace(self._moved((n, n), d0=F.col("d0") + max(0, -num), d1=F.col("d0") + max(0, num)), sparse=True)
        return at.dense()

    def diag_extract(self, num: int = 0) -> Tensor:
        n = max(0, min(self.dims[0] + min(num, 0), self.dims[1] - max(num, 0)))
        at = replace(self, df=self.df.where(F.col("d1") - F.col("d0") == num))
        return at._moved((n, 1, *self.dims[2:]), d0=F.least("d0", "d1"), d1=F.lit(0))

    def pad(self, before: Sequence[int], after: Sequence[int], border: str = "zero") -> Tensor:
        """border: "zero", "clamp", "periodic" or "symmetric" (the edge element is repeated)."""
        before, after = (*before, *[0] * (4 - len(before))), (*after, *[0] * (4 - len(after)))
        dims = tuple(b + n + a for b, n, a in zip(before, self.dims, after, strict=True))
        if border == "zero":
            return replace(self._moved(dims, **{c: F.col(c) + b for c, b in zip(COORDS, before, strict=True)}), sparse=True).dense()
        out = self.df
        for c, b, n, a in zip(COORDS, before, self.dims, after, strict=True):
            if not (a or b):
                continue
            # where each element goes: at most once in every period that reaches into the border
            if border == "clamp":
                low = F.when(F.col(c) == 0, F.sequence(F.lit(-b), F.lit(0))).otherwise(F.array(F.col(c).cast("int")))
                if n == 1:
                    spots = F.sequence(F.lit(-b), F.lit(a))
                else:
                    spots = F.when(F.col(c) == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + a))).otherwise(low)
            elif border == "periodic":
                spots = F.array(*[(F.col(c) + k * n).cast("int") for k in range(-math.ceil(b / n), math.ceil(a / n) + 1)])
            else:
                even = [(F.col(c) + k * n).cast("int") for k in range(-math.ceil(b / n), math.ceil(a / n) + 1) if k % 2 == 0]
                odd = [(n - 1 - F.col(c) + k * n).cast("int") for k in range(-math.ceil(b / n), math.ceil(a / n) + 1) if k % 2]
                spots = F.array(*even, *odd)
            out = out.withColumn("__s", F.explode(spots)).where(F.col("__s").between(-b, n - 1 + a)).withColumn(c, (F.col("__s") + b).cast("long")).drop("__s")
        return replace(self, df=out.select(*COORDS, "v"), dims=dims)

    def select(self, cond: Tensor, other) -> Tensor:
        """self where cond isn't zero, else other (a tensor or a number)."""
        picked = self.zip(cond, lambda v, c: F.struct(v.alias("v"), E.true(c).alias("c")), self.dtype)
        if isinstance(other, Tensor):
            return picked.zip(other, lambda p, b: F.when(p["c"], p["v"]).otherwise(b), dtypes.promote(self.dtype, other.dtype))
        return picked.map(lambda p: F.when(p["c"], p["v"]).otherwise(F.lit(other)))

    replace_where = select

    # indexing --------------------------------------------------------------------------

    @staticmethod
    def span(s: slice | int, n: int) -> tuple[int, int, int]:
        """(begin, elements, step) of a Python slice or index; negatives count from the end."""
        if isinstance(s, int):
            return s % n, 1, 1
        begin, stop, step = s.indices(n)
        return begin, len(range(begin, stop, step)), step

    def __getitem__(self, key) -> Tensor:
        """Per dimension a slice, a whole number, or indices: a list or a tensor of them (see lookup), or of booleans that pick positions."""
        key = key if isinstance(key, tuple) else (key,)
        out = self
        for k, s in enumerate(key):
            if isinstance(s, (list, Tensor)):
                out = out.lookup(self._indices(s), k)
                continue
            begin, count, step = self.span(s, out.dims[k])
            c = F.col(COORDS[k])
            at = F.floor((c - begin) / step)
            kept = out.df.where((F.pmod(c - begin, F.lit(abs(step))) == 0) & at.between(0, count - 1))
            out = replace(out, df=kept)._moved((*out.dims[:k], count, *out.dims[k + 1 :]), **{COORDS[k]: at})
        return out

    def _indices(self, s: list | Tensor) -> Tensor:
        """Indices as a tensor; booleans become the positions of the true ones."""
        if isinstance(s, Tensor):
            return s.where() if s.dtype == "b8" else s
        if s and isinstance(s[0], bool):
            s = [i for i, x in enumerate(s) if x]
        return Tensor.host(self.df.sparkSession, s, dtype="s64")

    def lookup(self, indices: Tensor, dim: int = 0) -> Tensor:
        """Elements along dim at the positions in a tensor of any shape, in its linear order; those out of range are reflected.

        A NULL index gives NULL elements (in a sparse tensor: none). Indices stay on the executors; hot ones are split (skeinframe.operators.gather).
        """
        from skeinframe.operators.gather import meet

        c, n = COORDS[dim], self.dims[dim]
        if not n and indices.elements:
            raise IndexError("no element to look up")
        at = indices.df.select(linear(indices.dims).alias("__to"), F.coalesce(reflect(F.col("v"), n), F.lit(0)).alias(c), F.col("v").isNull().alias("__none"))
        if self.sparse:
            at = at.where("NOT __none")
        joined = meet(self.df.select(*COORDS, "v"), at, c, indices.elements, self.elements // max(n, 1))
        v = F.when(~F.col("__none"), F.col("v")).alias("v")
        return replace(self, df=joined.select(*[F.col("__to").alias(c) if x == c else x for x in COORDS], v), dims=(*self.dims[:dim], indices.elements, *self.dims[dim + 1 :]))

    def assign(self, key, value) -> Tensor:
        """A new tensor with value (a tensor or a number) in the places that key names, as __getitem__ takes it.

        Of places that are named twice the last one, in value's linear order, wins; out of range ones are reflected, a NULL index names none.
        """
        from skeinframe.operators.gather import meet

        key = key if isinstance(key, tuple) else (key,)
        key = (*key, *[slice(None)] * (4 - len(key)))
        spots = [self._indices(s) if isinstance(s, (list, Tensor)) else self.span(s, self.dims[k]) for k, s in enumerate(key)]
        counts = [s.elements if isinstance(s, Tensor) else s[1] for s in spots]
        spark = self.df.sparkSession
        patch = value if isinstance(value, Tensor) else Tensor.constant(spark, value, counts, self.dtype)
        if patch.dims != full(counts):
            patch = patch.zip(Tensor.constant(spark, 0, counts), lambda a, b: a, patch.dtype)
        df = patch.df.withColumn("__n", linear(counts))
        for k, (c, s) in enumerate(zip(COORDS, spots, strict=True)):
            if isinstance(s, Tensor):
                at = s.df.where("v is not null").select(linear(s.dims).alias(c), reflect(F.col("v"), self.dims[k]).alias("__at"))
                df = meet(df, at, c, s.elements, patch.elements // max(s.elements, 1), unique=True).drop(c).withColumnRenamed("__at", c)
            elif s != (0, self.dims[k], 1):
                df = df.withColumn(c, F.col(c) * s[2] + s[0])
        df = df.groupBy(*COORDS).agg(F.max_by("v", "__n").alias("__v"))
        joined = self.df.join(df.withColumn("__hit", F.lit(True)), list(COORDS), "left")
        return replace(self, df=joined.select(*COORDS, F.when(F.col("__hit"), F.col("__v")).otherwise(F.col("v")).cast(dtypes.SPARK[self.dtype]).alias("v")))

    # reducing along a dimension -----------------------------------------------------------

    def reduce(self, op: str, dim: int | None = None, nanval: float | None = None) -> Tensor:
        """op of skeinframe.operators.reduce along dim; the first of more than one element by default. Beyond the rank: unchanged."""
        dim = first_dim(self.dims) if dim is None else dim
        if dim >= max(self.ndims, 1):
            return self
        others = [c for k, c in enumerate(COORDS) if k != dim]
        out = R.reduce(self.df, "v", [op], others, nanval)
        dtype = {"count": "u32", "all_true": "b8", "any_true": "b8"}.get(op, dtypes.sum_type(self.dtype) if op in ("sum", "product") else self.dtype)
        v = F.col(op) if op in ("all_true", "any_true") else F.col(op).cast(dtypes.SPARK[dtype])
        return Tensor(out.select(*[F.col(c) if c in others else F.lit(0).cast("long").alias(c) for c in COORDS], v.alias("v")), (*self.dims[:dim], 1, *self.dims[dim + 1 :]), dtype)

    def reduce_all(self, op: str, nanval: float | None = None):
        return R.reduce(self.df, "v", [op], nanval=nanval).first()[0]

    def scan(self, op: str = "add", dim: int | None = None, inclusive: bool = True) -> Tensor:
        from skeinframe.operators.scan import scan

        dim = first_dim(self.dims) if dim is None else dim
        # a vector has no lanes: it is scanned in blocks
        others = [c for k, c in enumerate(COORDS) if k != dim and self.dims[k] > 1]
        return replace(self, df=scan(self.df, "v", [COORDS[dim]], op, inclusive, others, "__s").select(*COORDS, F.col("__s").alias("v")))

    def sort(self, dim: int = 0, ascending: bool = True) -> Tensor:
        """Along dim. A vector has no lanes: its ranks are distributed, equal values in order of their places."""
        from skeinframe.operators.order import ranked

        others = [c for k, c in enumerate(COORDS) if k != dim]
        lanes = [c for k, c in enumerate(COORDS) if k != dim and self.dims[k] > 1]
        order = [F.col("v").asc() if ascending else F.col("v").desc(), F.col(COORDS[dim]).asc()]
        out = ranked(self.df.select(*COORDS, "v"), order, lanes, "__rank")
        return replace(self, df=out.select(*others, F.col("__rank").alias(COORDS[dim]), "v").select(*COORDS, "v"))

    def where(self) -> Tensor:
        """Linear indices of the elements that aren't zero, ascending; the count of them is found first.

        Places are counted in blocks of indices, of which only the totals meet.
        """
        from skeinframe.operators.scan import scan

        hits = self.df.where(E.true(F.col("v"))).select(linear(self.dims).alias("i"), F.lit(1).alias("one"))
        n = hits.count()
        return Tensor.of(scan(hits, "one", ["i"], name="place").select((F.col("place") - 1).alias("d0"), F.col("i").alias("v")), [n], "u32")

    # matrices --------------------------------------------------------------------------

    def matmul(self, other: Tensor, trans_a: bool = False, trans_b: bool = False) -> Tensor:
        """Product of matrices, batched over d2 and d3 (of one element: repeated). Rows missing from a sparse operand are zeros.

        Products of few elements are a join on the inner dimension and a sum with a partial step before the shuffle; a small
        operand is broadcast. NULLs count as zero. Large dense ones go by tiles (skeinframe.operators.tiles). The shapes tell which.
        """
        a = self.transpose(True) if trans_a else self
        b = other.transpose(True) if trans_b else other
        if a.dims[1] != b.dims[0]:
            raise ValueError(f"shapes {a.dims} and {b.dims} don't chain")
        on, batch = [], []
        for k, c in ((2, "d2"), (3, "d3")):
            if a.dims[k] != b.dims[k] and 1 not in (a.dims[k], b.dims[k]):
                raise ValueError("batches differ")
            if a.dims[k] == b.dims[k]:
                on.append(c)
            batch.append(max(a.dims[k], b.dims[k]))
        dtype = dtypes.promote(a.dtype, b.dtype)
        dims = (a.dims[0], b.dims[1], *batch)
        if dtype in ("f32", "f64") and not (a.sparse or b.sparse) and math.prod(dims) * a.dims[1] > JOINED_PRODUCTS:
            from skeinframe.operators.tiles import product

            return Tensor(product(a.df, b.df, a.dims, b.dims), full(dims), dtype)
        left = a.df.select("d0", F.col("d1").alias("k"), *[F.col(c) if c in on else F.col(c).alias(f"l{c}") for c in ("d2", "d3")], F.col("v").alias("lv"))
        right = b.df.select(F.col("d0").alias("k"), "d1", *[F.col(c) if c in on else F.col(c).alias(f"r{c}") for c in ("d2", "d3")], F.col("v").alias("rv"))
        if b.elements <= BROADCAST_ELEMENTS and b.elements <= a.elements:
            right = F.broadcast(right)
        elif a.elements <= BROADCAST_ELEMENTS:
            left = F.broadcast(left)
        joined = left.join(right, ["k", *on])
        depth = [F.col(c) if c in on else F.col(f"l{c}" if a.dims[k] >= b.dims[k] else f"r{c}").alias(c) for k, c in ((2, "d2"), (3, "d3"))]
        if dtypes.is_complex(dtype):
            x, y = (dtypes.cast(F.col(n), t.dtype, dtype) for n, t in (("lv", a), ("rv", b)))
            z = E.cmul(x, y)
            sums = joined.select("d0", "d1", *depth, z["re"].alias("re"), z["im"].alias("im")).groupBy(*COORDS).agg(E.cplx(F.sum("re"), F.sum("im")).alias("v"))
            return Tensor(sums, full(dims), "c64", a.sparse and b.sparse)
        sums = joined.select("d0", "d1", *depth, (F.col("lv") * F.col("rv")).alias("p")).groupBy(*COORDS).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("v"))
        out = Tensor(sums, full(dims), dtype, a.sparse or b.sparse)
        return out.dense() if out.sparse and not (a.sparse and b.sparse) else out

    def gemm(self, other: Tensor, alpha: float = 1.0, beta: float = 0.0, c: Tensor | None = None, trans_a: bool = False, trans_b: bool = False) -> Tensor:
        out = self.matmul(other, trans_a, trans_b).map(lambda v: v * alpha)
        return out if c is None else out.zip(c, lambda p, v: p + beta * v)

    def dot(self, other: Tensor, conjugate: tuple[bool, bool] = (False, False)):
        """Inner product of two vectors, as a one-element tensor."""
        a, b = self.flat(), other.flat()
        if self.is_complex() or other.is_complex():
            a, b = (t.cast("c64").map(E.conjg) if c else t.cast("c64") for t, c in zip((a, b), conjugate, strict=True))
            p = a.zip(b, E.cmul).df.agg(E.cplx(F.sum("v.re"), F.sum("v.im")).alias("v"))
            return Tensor.of(p, [1], "c64")
        return Tensor.of(a.zip(b, E.mul).df.agg(F.sum("v").alias("v")), [1], dtypes.promote(self.dtype, other.dtype))

    # sparse ----------------------------------------------------------------------------

    def to_sparse(self) -> Tensor:
        return replace(self, df=self.df.where(E.true(F.col("v"))), sparse=True)

    def dense(self) -> Tensor:
        """Rows for all elements; those that were missing are zero."""
        if not self.sparse:
            return self
        cells = Tensor.grid(self.df.sparkSession, self.dims).df.drop("v")
        zero = E.cplx(0.0, 0.0) if self.is_complex() else F.lit(0).cast(dtypes.SPARK[self.dtype])
        return replace(self, df=cells.join(self.df, list(COORDS), "left").select(*COORDS, F.coalesce("v", zero).alias("v")), sparse=False)

    def nnz(self) -> int:
        return self.df.where(E.true(F.col("v"))).count()


def chain_matmul(*matrices: Tensor) -> Tensor:
    """A product of several matrices, in the order that takes the fewest multiplications."""
    n = [matrices[0].dims[0], *(m.dims[1] for m in matrices)]
    k = len(matrices)
    best: dict[tuple[int, int], tuple[float, int]] = {(i, i): (0.0, i) for i in range(k)}
    for size in range(1, k):
        for i in range(k - size):
            j = i + size
            best[i, j] = min((best[i, s][0] + best[s + 1, j][0] + n[i] * n[s + 1] * n[j + 1], s) for s in range(i, j))

    def product(i: int, j: int) -> Tensor:
        if i == j:
            return matrices[i]
        s = best[i, j][1]
        return product(i, s).matmul(product(s + 1, j))

    return product(0, k - 1)


def sparse_from_csr(spark: SparkSession, rows: int, columns: int, values: Sequence[float], row_ptr: Sequence[int], col_idx: Sequence[int]) -> Tensor:
    """From compressed rows on the driver."""
    coo = [(i, int(col_idx[n]), float(values[n])) for i in range(rows) for n in range(row_ptr[i], row_ptr[i + 1])]
    return Tensor.of(spark.createDataFrame(coo, "d0 long, d1 long, v double"), [rows, columns], sparse=True)


def sparse_from_coo(df: DataFrame, rows: int, columns: int, row: str = "row", column: str = "col", value: str = "v") -> Tensor:
    return Tensor.of(df.select(F.col(row).alias("d0"), F.col(column).alias("d1"), F.col(value).alias("v")), [rows, columns], sparse=True)


def to_csr(t: Tensor) -> tuple[DataFrame, DataFrame]:
    """(row pointers: row, ptr for 0..rows; entries: n, col, v by row and column)."""
    from skeinframe.operators.scan import scan

    spark = t.df.sparkSession
    counts = t.df.groupBy("d0").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(t.dims[0] + 1).withColumnRenamed("id", "row")
    joined = every.join(counts.select((F.col("d0") + 1).alias("row"), "n"), "row", "left")
    pointers = scan(joined.select("row", F.coalesce("n", F.lit(0)).alias("n")), "n", ["row"], name="ptr").select("row", "ptr")
    begin = pointers.select(F.col("row").alias("d0"), F.col("ptr").alias("base"))
    within = F.row_number().over(Window.partitionBy("d0").orderBy("d1")) - 1
    return pointers, t.df.withColumn("k", within).join(begin, "d0").select((F.col("base") + F.col("k")).alias("n"), F.col("d1").alias("col"), "v")
