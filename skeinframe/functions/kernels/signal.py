"""Transforms, convolutions, filters and interpolation along the first dimensions of an array."""

from __future__ import annotations

from functools import reduce

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

# transforms ---------------------------------------------------------------------------


def _sized(a, sizes):
    """Zero-padded or cut to sizes, along the first dimensions."""
    for axis, n in enumerate(sizes or ()):
        if n and n != a.shape[axis]:
            if n < a.shape[axis]:
                a = np.take(a, range(n), axis)
            else:
                a = np.pad(a, [(0, n - a.shape[axis]) if k == axis else (0, 0) for k in range(a.ndim)])
    return a


def fft(a, rank: int = 1, norm: float = 1.0, sizes=None):
    """Over the first `rank` dimensions, times norm."""
    return np.fft.fftn(_sized(a, sizes), axes=range(rank)) * norm


def ifft(a, rank: int = 1, norm: float | None = None, sizes=None):
    """norm None divides by the number of elements, as a plain inverse does; a number multiplies the bare sum."""
    a = _sized(a, sizes)
    n = np.prod(a.shape[:rank])
    return np.fft.ifftn(a, axes=range(rank)) * (1.0 if norm is None else norm * n)


def fft_r2c(a, rank: int = 1, norm: float = 1.0, sizes=None):
    """The half spectrum, of n0 // 2 + 1 along the first dimension."""
    a = np.asarray(_sized(a, sizes)).real
    return np.fft.rfftn(a, axes=[*range(1, rank), 0]) * norm


def fft_c2r(a, rank: int = 1, norm: float = 1.0, odd: bool = False):
    """From a half spectrum; norm multiplies the bare sum."""
    n0 = 2 * (a.shape[0] - 1) + odd
    sizes = [*a.shape[1:rank], n0]
    return np.fft.irfftn(a, s=sizes, axes=[*range(1, rank), 0]) * (norm * np.prod(sizes))


# convolution ---------------------------------------------------------------------------


def _full(a, k):
    """Full linear convolution over all dimensions of k; further ones of a are batches."""
    rank = k.ndim
    out = np.zeros((*(n + m - 1 for n, m in zip(a.shape, k.shape)), *a.shape[rank:]), np.result_type(a, k, float))
    for at in np.ndindex(*k.shape):
        if k[at] != 0:
            out[tuple(slice(i, i + n) for i, n in zip(at, a.shape[:rank]))] += k[at] * a
    return out


def _mode(full, a, k, expand: bool):
    return full if expand else full[tuple(slice(m // 2, m // 2 + n) for n, m in zip(a.shape, k.shape))]


def convolve(a, k, expand: bool = False):
    """Border zero; the default has the signal's shape and starts at half the filter's length."""
    return _mode(_full(a, k), a, k, expand)


def fft_convolve(a, k, expand: bool = False):
    rank, sizes = k.ndim, [n + m - 1 for n, m in zip(a.shape, k.shape)]
    spectrum = np.fft.fftn(k, sizes, axes=range(rank)).reshape(*sizes, *[1] * (a.ndim - rank))
    full = np.fft.ifftn(np.fft.fftn(a, sizes, axes=range(rank)) * spectrum, axes=range(rank))
    if not (np.iscomplexobj(a) or np.iscomplexobj(k)):
        full = full.real
    return _mode(full, a, k, expand)


def convolve_sep(a, column, row, expand: bool = False):
    """By a column filter along the first dimension and a row filter along the second."""
    return convolve(convolve(a, column.reshape(-1, 1), expand), row.reshape(1, -1), expand)


def _patches(a, k, stride, padding, dilation):
    a = np.pad(a, [(p, p) for p in padding] + [(0, 0)] * (a.ndim - 2))
    spans = [d * (n - 1) + 1 for d, n in zip(dilation, k.shape)]
    view = sliding_window_view(a, spans, (0, 1))[:: stride[0], :: stride[1]]
    return view[..., :: dilation[0], :: dilation[1]]


def convolve_nn(a, k, stride=(1, 1), padding=(0, 0), dilation=(1, 1)):
    """a: rows, columns, channels, batch; k: rows, columns, channels, filters; out: rows, columns, filters, batch. The filter is flipped."""
    a, k = a.reshape(*a.shape, *[1] * (4 - a.ndim)), k.reshape(*k.shape, *[1] * (4 - k.ndim))
    view = _patches(a, k, stride, padding, dilation)  # rows, columns, channels, batch, k0, k1
    return np.einsum("xycbij,ijcf->xyfb", view, k[::-1, ::-1])


def convolve_nn_gradient(gradient, a, k, by: str = "data", stride=(1, 1), padding=(0, 0), dilation=(1, 1)):
    """Of the sum of gradient * convolve_nn(a, k): with respect to the data or the filter."""
    a4, k4 = a.reshape(*a.shape, *[1] * (4 - a.ndim)), k.reshape(*k.shape, *[1] * (4 - k.ndim))
    g = gradient.reshape(*gradient.shape, *[1] * (4 - gradient.ndim))
    if by == "filter":
        out = np.einsum("xycbij,xyfb->ijcf", _patches(a4, k4, stride, padding, dilation), g)[::-1, ::-1]
        return out.reshape(k.shape)
    out = np.zeros((a4.shape[0] + 2 * padding[0], a4.shape[1] + 2 * padding[1], *a4.shape[2:]))
    flipped = k4[::-1, ::-1]
    for i in range(k4.shape[0]):
        for j in range(k4.shape[1]):
            part = np.einsum("xyfb,cf->xycb", g, flipped[i, j])
            x, y = i * dilation[0], j * dilation[1]
            out[x : x + stride[0] * g.shape[0] : stride[0], y : y + stride[1] * g.shape[1] : stride[1]] += part
    return out[padding[0] : padding[0] + a4.shape[0], padding[1] : padding[1] + a4.shape[1]].reshape(a.shape)


# filters -------------------------------------------------------------------------------


def fir(b, x):
    """y[i] = sum b[k] x[i-k], along the first dimension."""
    return convolve(x, b.ravel(), True)[: x.shape[0]]


def iir(b, a, x):
    """a[0] y[i] = sum b[k] x[i-k] - sum over k >= 1 of a[k] y[i-k]."""
    a, y = a.ravel(), fir(b, x).astype(np.result_type(a, b, x, float))
    for i in range(len(y)):
        for k in range(1, min(len(a), i + 1)):
            y[i] -= a[k] * y[i - k]
        y[i] /= a[0]
    return y


def _bordered(a, sizes, border: str):
    pads = [((n - 1) // 2 if n % 2 else n // 2, n // 2 if n % 2 else n - 1 - n // 2) for n in sizes] + [(0, 0)] * (a.ndim - len(sizes))
    return np.pad(a, pads, mode={"zero": "constant", "symmetric": "symmetric", "clamp": "edge", "periodic": "wrap"}[border])


def medfilt(a, sizes=(3, 3), border: str = "zero"):
    """Median over a window along the first dimensions; of an even number the mean of the middle two."""
    rank = len(sizes)
    view = sliding_window_view(_bordered(a, sizes, border), sizes, tuple(range(rank)))
    return np.median(view, axis=tuple(range(-rank, 0)))


# interpolation -----------------------------------------------------------------------------


def weights(x, method: str):
    """(offsets from floor(x), weights): neighbours of a position and their shares."""
    low = np.floor(x)
    t = x - low
    match method:
        case "nearest":
            return [(np.floor(x + 0.5) - low).astype(int)], [np.ones_like(t)]
        case "lower":
            return [np.zeros(t.shape, int)], [np.ones_like(t)]
        case "linear" | "cosine":
            if method == "cosine":
                t = (1 - np.cos(np.pi * t)) / 2
            return [0, 1], [1 - t, t]
        case "cubic":
            # polynomials of (v3-v2-v0+v1) t^3 + (2v0-2v1+v2-v3) t^2 + (v2-v0) t + v1, by neighbour
            return [-1, 0, 1, 2], [-(t**3) + 2 * t**2 - t, t**3 - 2 * t**2 + 1, -(t**3) + t**2 + t, t**3 - t**2]
        case "spline":
            # Catmull-Rom
            return [-1, 0, 1, 2], [(-(t**3) + 2 * t**2 - t) / 2, (3 * t**3 - 5 * t**2 + 2) / 2, (-3 * t**3 + 4 * t**2 + t) / 2, (t**3 - t**2) / 2]
    raise ValueError(f"no such interpolation: {method}")


def approx1(a, pos, method: str = "linear", off_grid: float = 0.0, start: float = 0.0, step: float = 1.0):
    """a, along its first dimension, at pos (a grid from start by step)."""
    x = (np.asarray(pos).real - start) / step
    n = a.shape[0]
    inside = ~((x < 0) | (n < x + 1))
    x = np.where(inside, x, 0.0)
    offsets, shares = weights(x, method)
    low = np.floor(x).astype(int)
    shape = (*x.shape, *[1] * (a.ndim - 1))
    out = sum(a[np.clip(low + o, 0, n - 1)] * w.reshape(shape) for o, w in zip(offsets, shares))
    return np.where(inside.reshape(shape), out, off_grid)


def sample2(a, x, y, method: str):
    """a at positions inside it; neighbours beyond an edge are clamped to it."""
    ox, wx = weights(x, method)
    oy, wy = weights(y, method)
    lx, ly = np.floor(x).astype(int), np.floor(y).astype(int)
    shape = (*x.shape, *[1] * (a.ndim - 2))
    return reduce(np.add, (a[np.clip(lx + p, 0, a.shape[0] - 1), np.clip(ly + q, 0, a.shape[1] - 1)] * (u * v).reshape(shape) for p, u in zip(ox, wx) for q, v in zip(oy, wy)))


#: Two-dimensional names of the one-dimensional methods; the cosine one weighs plainly in two dimensions.
PLANAR = {"bilinear": "linear", "bicubic": "cubic", "bicubic_spline": "spline", "bilinear_cosine": "linear"}


def approx2(a, pos0, pos1, method: str = "linear", off_grid: float = 0.0, start=(0.0, 0.0), step=(1.0, 1.0)):
    x, y = (np.asarray(pos0).real - start[0]) / step[0], (np.asarray(pos1).real - start[1]) / step[1]
    inside = ~((x < 0) | (a.shape[0] < x + 1) | (y < 0) | (a.shape[1] < y + 1))
    out = sample2(a, np.where(inside, x, 0.0), np.where(inside, y, 0.0), PLANAR.get(method, method))
    return np.where(inside.reshape(*x.shape, *[1] * (a.ndim - 2)), out, off_grid)
