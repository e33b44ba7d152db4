"""Operators on the neighbourhood of each element of a matrix that is larger than a row: tiles with halos.

Elements go to the task of their tile and, within `reach` of its border, to the tiles beside it: a tile of TILE x TILE gathers
(TILE + 2 reach)^2 elements, whatever the matrix, and there is no row for an element's neighbours. A tile sees what lies around it
up to the matrix's own edges, so that a rule for edges applies at these alone; what it gives for its halo is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skeinframe.functions.kernels import image as I
from skeinframe.functions.kernels import signal as S
from skeinframe.operators.tensor import Tensor

TILE = 256


def neighbourhood(t: Tensor, f: Callable[[np.ndarray], np.ndarray], reach: tuple[int, int], tile: int | None = None, missing: float = np.nan, placed: bool = False) -> Tensor:
    """f over every d0 x d1 matrix of t, a double an element; d2 and d3 count matrices.

    f takes a part of a matrix and gives as many values, each from elements within reach of its own. NULL elements and those without
    a row are given to f as `missing` (sparse tensors: 0), and get f's value. reach may not exceed the tile. placed: f also takes the
    row and column of the part's first element.
    """
    from skeinframe.operators.dense import ship

    tile = TILE if tile is None else tile
    rows, columns = t.dims[:2]
    if max(reach) > tile:
        raise ValueError(f"a reach of {reach} is beyond a tile of {tile}")
    ship(t.df.sparkSession)
    absent = 0.0 if t.sparse else missing
    bounds = ((rows, reach[0]), (columns, reach[1]))

    def near(c: str, n: int, h: int):
        """The tiles that see a coordinate."""
        last = -(-n // tile) - 1
        low, high = (F.least(F.greatest(F.floor((F.col(c) + x) / tile), F.lit(0)), F.lit(last)) for x in (-h, h))
        return F.explode(F.sequence(low.cast("long"), high.cast("long")))

    cells = t.df.select("d2", "d3", near("d0", *bounds[0]).alias("b0"), "d0", "d1", F.col("v").cast("double").alias("v"))
    cells = cells.select("d2", "d3", "b0", near("d1", *bounds[1]).alias("b1"), "d0", "d1", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, origin = None, None, None

        def done() -> pa.RecordBatch:
            d2, d3, *b = now
            out = np.asarray(f(part, *origin) if placed else f(part), dtype=float)
            own = tuple(slice(x * tile - o, min((x + 1) * tile, n) - o) for x, o, (n, _) in zip(b, origin, bounds))
            kept = out[own]
            i, j = (x.ravel() for x in np.indices(kept.shape))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (i + b[0] * tile, j + b[1] * tile, np.full(kept.size, d2), np.full(kept.size, d3), kept.ravel())], ["d0", "d1", "d2", "d3", "v"])

        for batch in batches:
            d2, d3, b0, b1, i, j = (batch.column(k).to_numpy() for k in range(6))
            v = batch.column(6)
            x = np.where(v.is_null().to_numpy(zero_copy_only=False), absent, v.to_numpy(zero_copy_only=False))
            change = (np.diff(d2) != 0) | (np.diff(d3) != 0) | (np.diff(b0) != 0) | (np.diff(b1) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(i)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                key = tuple(int(c[begin]) for c in (d2, d3, b0, b1))
                if key != now:
                    if part is not None:
                        yield done()
                    spans = [(max(0, b * tile - h), min(n, (b + 1) * tile + h)) for b, (n, h) in zip(key[2:], bounds)]
                    now, origin = key, [low for low, _ in spans]
                    part = np.full([high - low for low, high in spans], absent)
                part[i[begin:end] - origin[0], j[begin:end] - origin[1]] = x[begin:end]
        if part is not None:
            yield done()

    keys = ["d2", "d3", "b0", "b1"]
    out = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "d0 long, d1 long, d2 long, d3 long, v double")
    return Tensor(out, t.dims, "f64")


def _reach(shape) -> tuple[int, int]:
    return shape[0] // 2 + 1, shape[1] // 2 + 1


def convolve2(t: Tensor, kernel: np.ndarray, tile: int | None = None) -> Tensor:
    """By a small filter, zeros beyond the edges; the result has the tensor's shape and starts at half the filter's length. NULL is NaN."""
    k = np.asarray(kernel, dtype=float)
    return neighbourhood(t, lambda a: S.convolve(a, k), _reach(k.shape), tile)


def convolve2_sep(t: Tensor, column: np.ndarray, row: np.ndarray, tile: int | None = None) -> Tensor:
    c, r = np.asarray(column, dtype=float).ravel(), np.asarray(row, dtype=float).ravel()
    return neighbourhood(t, lambda a: S.convolve_sep(a, c, r), _reach((len(c), len(r))), tile)


def medfilt2(t: Tensor, sizes: tuple[int, int] = (3, 3), border: str = "zero", tile: int | None = None) -> Tensor:
    """Medians of windows; border "zero" or "symmetric". A window with a NULL or NaN is NaN."""
    return neighbourhood(t, lambda a: S.medfilt(a, sizes, border), _reach(sizes), tile)


def dilate(t: Tensor, mask: np.ndarray, border: str = "zero", tile: int | None = None) -> Tensor:
    """Largest element under the mask, border as skeinframe.functions.kernels.image.dilate."""
    m = np.asarray(mask)
    return neighbourhood(t, lambda a: I.dilate(a, m, border), _reach(m.shape), tile)


def erode(t: Tensor, mask: np.ndarray, border: str = "clamp", tile: int | None = None) -> Tensor:
    m = np.asarray(mask)
    return neighbourhood(t, lambda a: I.erode(a, m, border), _reach(m.shape), tile)


def minfilt(t: Tensor, size: int = 3, tile: int | None = None) -> Tensor:
    return erode(t, np.ones((size, size)), "clamp", tile)


def maxfilt(t: Tensor, size: int = 3, tile: int | None = None) -> Tensor:
    return neighbourhood(t, lambda a: I.maxfilt(a, size), _reach((size, size)), tile)


def bilateral(t: Tensor, spatial: float, chromatic: float, tile: int | None = None) -> Tensor:
    radius = max(int(min(11.5, max(spatial, 0.0)) * 1.5), 1)
    return neighbourhood(t, lambda a: I.bilateral(a, spatial, chromatic), (radius, radius), tile)


def sobel(t: Tensor, tile: int | None = None) -> tuple[Tensor, Tensor]:
    """(dx, dy). The border mirrors without repeating the edge, in a matrix of at least two rows and columns."""
    def one(k: int):
        # two rows or columns at least must be seen for the mirror: a reach of 2
        return neighbourhood(t, lambda a: I.sobel(a)[k], (2, 2), tile)

    return one(0), one(1)
