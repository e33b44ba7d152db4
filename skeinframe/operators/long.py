"""Filters of one long series that is a table, without lanes: recursive ones by a parallel prefix, long kernels by blocks with halos.

Rows are numbered in order (order.numbered) and go in blocks of successive numbers. What blocks need of each other is bounded
by the filter, not by the series: a state for a recursive filter, as many neighbouring values as the kernel is long for another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.operators.dense import ship
from skeinframe.operators.order import fresh, numbered

#: Rows of a block: of a recursive filter, which passes by in batches; of a kernel, which is held (at least; four kernels long at least).
PASSING, HELD = 1 << 20, 1 << 16
#: Taps from which blocks are transformed.
DIRECT = 64
#: Steps of a stretch of a recursive filter; stretches go side by side.
STRETCH = 256


class Recursion:
    """The filter b / a as state' = M state + g x, y = state[0] + b[0] x."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        if not len(a) or a[0] == 0:
            raise ValueError("a[0] must not be zero")
        n = max(len(a), len(b), 2)
        b, a = (np.pad(np.asarray(c, float) / a[0], (0, n - len(c))) for c in (b, a))
        self.first = b[0]
        self.matrix = np.eye(n - 1, k=1)
        self.matrix[:, 0] -= a[1:]
        self.gain = b[1:] - a[1:] * b[0]

    @property
    def size(self) -> int:
        return len(self.gain)

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.matrix, n)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and the state after x. Stretches run side by side from zero, their states are chained, and what these add is added."""
        whole = len(x) // STRETCH * STRETCH
        parts = []
        if whole:
            y, ends = self._steps(x[:whole].reshape(-1, STRETCH), np.zeros((whole // STRETCH, self.size)))
            step, starts = self.power(STRETCH), np.empty_like(ends)
            for j, end in enumerate(ends):
                starts[j], state = state, step @ state + end
            echo, row = np.empty((STRETCH, self.size)), np.eye(self.size)[0]
            for t in range(STRETCH):
                echo[t], row = row, row @ self.matrix
            parts.append((y + starts @ echo.T).ravel())
        if whole < len(x):
            y, ends = self._steps(x[None, whole:], state[None])
            parts.append(y[0])
            state = ends[0]
        return np.concatenate(parts) if parts else np.zeros(0), state

    def _steps(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.empty(x.shape)
        for t in range(x.shape[1]):
            y[:, t] = state[:, 0] + self.first * x[:, t]
            state = state @ self.matrix.T + x[:, t, None] * self.gain
        return y, state


def iir_long(df: DataFrame, value: str, b: Sequence[float], a: Sequence[float], order: Sequence[str], name: str = "iir", block: int = PASSING) -> DataFrame:
    """df with y[i] = (sum b[k] x[i-k] - sum over k > 0 of a[k] y[i-k]) / a[0], zero before the start, over all rows in order.

    A block's effect on the state is an affine map: one pass finds each block's offset, from a zero state; maps are chained over
    blocks (a vector as long as the filter each, 2^20 rows apart); a second pass runs each block from its own state. Rows pass by in
    batches. Rows that share an order come in any order, those without one first. NULL and NaN make NaN of all that follows.
    """
    ship(df.sparkSession)
    at, part = fresh(df, "__at"), fresh(df, "__part")
    rows = numbered(df, [F.col(f"`{c}`").asc() for c in order], at)
    rows = rows.withColumn(part, F.floor(F.col(at) / block)).repartition(part).sortWithinPartitions(part, at)
    filter_ = Recursion(b, a)
    values = lambda column: pc.fill_null(pc.cast(column, pa.float64()), np.nan).to_numpy(zero_copy_only=False)

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        """Of a batch whose last but one column is the block: (block, first row, end row)."""
        blocks = batch.column(batch.num_columns - 1).to_numpy()
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
        for i, j in zip(edges, [*edges[1:], len(blocks)]):
            yield int(blocks[i]), int(i), int(j)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n]), pa.array([state.tolist()], pa.list_(pa.float64()))], ["part", "n", "state"])
        for batch in batches:
            x = values(batch.column(0))
            for block_, i, j in stretches(batch):
                if block_ != now:
                    if now is not None:
                        yield row()
                    now, state, n = block_, np.zeros(filter_.size), 0
                _, state = filter_.run(x[i:j], state)
                n += j - i
        if now is not None:
            yield row()

    found = sorted(rows.select(F.col(f"`{value}`").cast("double"), part).mapInArrow(offsets, "part long, n long, state array<double>").collect())
    state, starts, powers = np.zeros(filter_.size), {}, {}
    for block_, n, offset in found:
        starts[block_] = state
        powers.setdefault(n, filter_.power(n))
        state = powers[n] @ state + np.array(offset)
    held = df.sparkSession.sparkContext.broadcast(starts)
    keep = [c for c in df.columns if c != name]
    at_value = keep.index(value) if value in keep else len(keep)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            x, out = values(batch.column(at_value)), []
            for block_, i, j in stretches(batch):
                if block_ != now:
                    now, state = block_, held.value[block_]
                y, state = filter_.run(x[i:j], state)
                out.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, name])

    chosen = rows.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{value}`")] if value not in keep else []), part)
    kinds = dict(df.dtypes)
    return chosen.mapInArrow(filtered, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"]))


def kernel_long(df: DataFrame, value: str, kernel: Sequence[float], order: Sequence[str], ahead: int, name: str, block: int | None = None) -> DataFrame:
    """df with y[i] = sum kernel[k] x[i + ahead - k] over all rows in order, zeros beyond both ends, 0 <= ahead < taps. NULL counts as zero.

    A row goes to its block, and its value alone to the neighbour whose outputs need it. Kernels of more than DIRECT taps go by
    transforms of a block with its halo, but blocks that hold NaN or infinity, which must not spread, by sums. Rows without an
    order come first.
    """
    ship(df.sparkSession)
    taps = np.asarray(kernel, float)
    n = len(taps)
    if not n or not 0 <= ahead < n:
        raise ValueError("an empty kernel, or one that doesn't reach its own place")
    size = max(block or HELD, n if block else 4 * n)
    behind = n - 1 - ahead
    at, part, own = fresh(df, "__at"), fresh(df, "__part"), fresh(df, "__own")
    x = fresh(df, "__x")
    keep = [c for c in df.columns if c != name]
    rows = numbered(df, [F.col(f"`{c}`").asc() for c in order], at).withColumn(x, F.coalesce(F.col(f"`{value}`").cast("double"), F.lit(0.0)))
    mine, place = F.floor(F.col(at) / size), F.pmod(F.col(at), F.lit(size))
    whole = rows.select(*[F.col(f"`{c}`") for c in keep], x, at, mine.alias(part), F.lit(True).alias(own))
    # values for the next block, and for the one before
    halo = F.array_compact(F.array(F.when(place >= size - behind, mine + 1), F.when((place < ahead) & (mine > 0), mine - 1)))
    lent = rows.where((place >= size - behind) | (place < ahead)).select(x, at, F.explode(halo).alias(part), F.lit(False).alias(own))
    met = whole.unionByName(lent, allowMissingColumns=True).repartition(part).sortWithinPartitions(part, at)
    kinds, schema = dict(df.dtypes), None
    k = len(keep)

    def convolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def results() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            value_, place_, own_ = (table.column(c).to_numpy() for c in (k, k + 1, k + 3))
            mine_ = np.flatnonzero(own_)
            if not len(mine_):
                return
            # from `behind` values before the block's first row to `ahead` after its last, zeros where there are none
            first = place_[mine_[0]] - behind
            padded = np.zeros(len(mine_) + n - 1)
            at_ = place_ - first
            inside = (at_ >= 0) & (at_ < len(padded))
            padded[at_[inside]] = value_[inside]
            if n <= DIRECT or not np.isfinite(padded).all():
                y = np.convolve(padded, taps, "valid")
            else:
                m = 1 << (len(padded) - 1).bit_length()
                y = np.fft.irfft(np.fft.rfft(padded, m) * np.fft.rfft(taps, m), m)[n - 1 : len(padded)]
            out = table.take(pa.array(mine_)).select(range(k)).append_column(name, pa.array(y))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            blocks = batch.column(k + 2).to_numpy()
            edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for i, j in zip(edges, [*edges[1:], len(blocks)]):
                if held and blocks[i] != now:
                    yield from results()
                    held.clear()
                now = blocks[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from results()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"])
    return met.mapInArrow(convolved, schema)


def fir_long(df: DataFrame, value: str, b: Sequence[float], order: Sequence[str], name: str = "fir", block: int | None = None) -> DataFrame:
    """y[i] = sum b[k] x[i-k]; see kernel_long()."""
    return kernel_long(df, value, b, order, 0, name, block)


def convolve_long(df: DataFrame, value: str, kernel: Sequence[float], order: Sequence[str], name: str = "conv", block: int | None = None) -> DataFrame:
    """As long as the series, starting at half the kernel's length; see kernel_long()."""
    return kernel_long(df, value, kernel, order, len(kernel) // 2, name, block)
