"""Image operators: arrays of rows, columns and channels."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from skeinframe.functions.kernels.signal import PLANAR, convolve, sample2

# geometry --------------------------------------------------------------------------------


def gradient(a):
    """(along the first dimension, along the second): central differences, one-sided at the edges."""
    return tuple(np.gradient(a, axis=k) if a.shape[k] > 1 else np.zeros(a.shape) for k in (0, 1))


def resize(a, rows: int, columns: int, method: str = "nearest"):
    fx, fy = a.shape[0] / rows, a.shape[1] / columns
    x, y = np.arange(rows) * fx, np.arange(columns) * fy
    if method in ("nearest", "lower"):
        i, j = ((np.floor(p + 0.5) if method == "nearest" else np.floor(p)).astype(int).clip(0, n - 1) for p, n in ((x, a.shape[0]), (y, a.shape[1])))
        return a[np.ix_(i, j)]
    gx, gy = np.meshgrid(x.clip(0, a.shape[0] - 1), y.clip(0, a.shape[1] - 1), indexing="ij")
    return sample2(a, gx, gy, PLANAR.get(method, method))


def transform(a, matrix, rows: int, columns: int, method: str = "nearest", inverse: bool = True):
    """Warp by a 3x2 (affine) or 3x3 (perspective) matrix, columns of which give x, y (and w) from (x, y, 1); inverse: it maps from the result to a. Outside a: zero."""
    m = np.asarray(matrix).real
    m = np.vstack([m.T, [0, 0, 1]]) if m.shape == (3, 2) else m.T
    if not inverse:
        m = np.linalg.inv(m)
    gx, gy = np.meshgrid(np.arange(rows, dtype=float), np.arange(columns, dtype=float), indexing="ij")
    w = m[2, 0] * gx + m[2, 1] * gy + m[2, 2]
    x, y = (m[0, 0] * gx + m[0, 1] * gy + m[0, 2]) / w, (m[1, 0] * gx + m[1, 1] * gy + m[1, 2]) / w
    inside = (x >= -1e-4) & (x < a.shape[0]) & (y >= -1e-4) & (y < a.shape[1])
    out = sample2(a, np.where(inside, np.maximum(x, 0), 0.0), np.where(inside, np.maximum(y, 0), 0.0), PLANAR.get(method, method))
    return np.where(inside.reshape(rows, columns, *[1] * (a.ndim - 2)), out, 0.0)


def transform_coordinates(matrix, rows: float, columns: float):
    """The corners (0,0), (0,columns), (rows,columns), (rows,0) through a 3x2 or 3x3 matrix."""
    m = np.asarray(matrix).real
    corners = np.array([[0, 0, 1], [0, columns, 1], [rows, columns, 1], [rows, 0, 1]], float)
    out = corners @ m
    return out[:, :2] / out[:, 2:] if m.shape[1] == 3 else out


def rotate(a, theta: float, crop: bool = True, method: str = "nearest"):
    """About the centre; crop keeps the shape, else the result holds all of a. The matrix is rounded to thousandths."""
    c, s = np.cos(-theta), np.sin(-theta)
    n0, n1 = a.shape[:2]
    m0, m1 = (n0, n1) if crop else (int(abs(n0 * c) + abs(n1 * s) + 0.5), int(abs(n0 * s) + abs(n1 * c) + 0.5))
    mid, out = (np.array([n0 - 1, n1 - 1]) / 2), (np.array([m0 - 1, m1 - 1]) / 2)
    turn = np.array([[c, -s], [s, c]])
    shift = mid - turn @ out
    matrix = np.round(np.hstack([turn, shift[:, None]]) * 1000) / 1000
    return transform(a, matrix.T, m0, m1, method)


def translate(a, by0: float, by1: float, rows: int | None = None, columns: int | None = None, method: str = "nearest"):
    return transform(a, np.array([[1, 0], [0, 1], [-by0, -by1]], float), rows or a.shape[0], columns or a.shape[1], method)


def scale(a, scale0: float, scale1: float, rows: int | None = None, columns: int | None = None, method: str = "nearest"):
    rows, columns = rows or int(a.shape[0] / scale0), columns or int(a.shape[1] / scale1)
    return transform(a, np.array([[scale0, 0], [0, scale1], [0, 0]], float), rows, columns, method)


def skew(a, skew0: float, skew1: float, rows: int | None = None, columns: int | None = None, method: str = "nearest", inverse: bool = True):
    t0, t1 = np.tan(skew0), np.tan(skew1)
    return transform(a, np.array([[1, t1], [t0, 1], [0, 0]], float), rows or a.shape[0], columns or a.shape[1], method, inverse)


# neighbourhoods ---------------------------------------------------------------------------


def _around(a, shape, mode: str, **fill):
    pads = [(n // 2, n - 1 - n // 2) for n in shape] + [(0, 0)] * (a.ndim - len(shape))
    return sliding_window_view(np.pad(a, pads, mode=mode, **fill), shape, tuple(range(len(shape))))


def dilate(a, mask, border: str = "zero"):
    """Largest under the mask. border: "zero" (2-D default of this operator), "clamp", or "ignore" (used for 3-D masks)."""
    ignore = border == "ignore" or mask.ndim > 2
    view = _around(a, mask.shape, "edge" if border == "clamp" else "constant", **({} if border == "clamp" else {"constant_values": -np.inf if ignore else 0}))
    return np.where(mask.real != 0, view, -np.inf).max(axis=tuple(range(-mask.ndim, 0)))


def erode(a, mask, border: str = "clamp"):
    """Smallest under the mask. border as for dilate; the 2-D default clamps to the edge."""
    ignore = border == "ignore" or mask.ndim > 2
    clamp = border == "clamp" and not ignore
    view = _around(a, mask.shape, "edge" if clamp else "constant", **({} if clamp else {"constant_values": np.inf if ignore else 0}))
    return np.where(mask.real != 0, view, np.inf).min(axis=tuple(range(-mask.ndim, 0)))


def minfilt(a, size: int = 3):
    return erode(a, np.ones((size, size)))


def maxfilt(a, size: int = 3):
    return dilate(a, np.ones((size, size)))


def bilateral(a, spatial: float, chromatic: float):
    """Spatial deviation at most 11.5; a radius of 1.5 of it, 1 at least; edges clamped."""
    s = min(11.5, max(spatial, 0.0))
    radius = max(int(s * 1.5), 1)
    n = 2 * radius + 1
    view = _around(a, (n, n), "edge")
    o = np.arange(-radius, radius + 1)
    space = (o[:, None] ** 2 + o**2) / (-2.0 * s * s)
    w = np.exp(space + (a[..., None, None] - view) ** 2 / (-2.0 * chromatic**2))
    return (w * view).sum(axis=(-1, -2)) / w.sum(axis=(-1, -2))


def mean_shift(a, spatial: float, chromatic: float, iterations: int):
    """Each pixel climbs to the mean of the near pixels of near colour, all pixels at a time. Mean places and colours lose their
    fractions in every round. A pixel stops where its place stays, or where place and colour move by 1 or less. Channels along the
    third dimension count together."""
    image = np.asarray(a, float).reshape(*a.shape[:2], -1)
    (rows, columns, _), radius = image.shape, max(int(spatial * 1.5), 1)
    padded = np.pad(image, [(radius, radius), (radius, radius), (0, 0)], constant_values=np.nan)  # NaN is near nothing
    offset = np.arange(-radius, radius + 1)
    x, y = (g.ravel() for g in np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij"))
    colour, going = image[x, y], np.arange(rows * columns)
    for _ in range(iterations):
        at, old = (x[going], y[going]), colour[going]
        spots = np.broadcast_arrays(at[0][:, None, None] + offset[:, None], at[1][:, None, None] + offset)
        part = padded[spots[0] + radius, spots[1] + radius]
        near = ((part - old[:, None, None]) ** 2).sum(axis=3) <= chromatic**2
        count = near.sum(axis=(1, 2))
        some = np.maximum(count, 1)
        mean = [np.trunc((near * s).sum(axis=(1, 2)) / some).astype(int) for s in spots]
        new = np.trunc(np.where(near[..., None], part, 0).sum(axis=(1, 2)) / some[:, None])
        moved = abs(mean[0] - at[0]) + abs(mean[1] - at[1])
        stop = (moved == 0) | (moved + ((new - old) ** 2).sum(axis=1) <= 1)
        found = count > 0
        x[going[found]], y[going[found]], colour[going[found]] = mean[0][found], mean[1][found], new[found]
        going = going[found & ~stop]
        if not len(going):
            break
    return colour.reshape(a.shape)


def regions(a, connectivity: int = 4):
    """Connected parts of the non-zero pixels, numbered from 1 in column-major order of their first pixel; 0 elsewhere."""
    on = np.asarray(a) != 0
    n0, n1 = on.shape
    index = np.arange(n0 * n1).reshape(n0, n1, order="F")
    pairs = [(index[:-1], index[1:], on[:-1] & on[1:]), (index[:, :-1], index[:, 1:], on[:, :-1] & on[:, 1:])]
    if connectivity == 8:
        pairs += [(index[:-1, :-1], index[1:, 1:], on[:-1, :-1] & on[1:, 1:]), (index[1:, :-1], index[:-1, 1:], on[1:, :-1] & on[:-1, 1:])]
    label = np.arange(n0 * n1)
    p, q = (np.concatenate([x[k][x[2]] for x in pairs]) for k in (0, 1))
    while True:
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    flat = on.ravel(order="F")
    out = np.zeros(n0 * n1)
    out[flat] = np.unique(label[flat], return_inverse=True)[1] + 1
    return out.reshape(n0, n1, order="F")


def sobel(a):
    """(dx, dy) by the 3x3 operator; the border mirrors without repeating the edge."""
    p = np.pad(a, [(1, 1), (1, 1)] + [(0, 0)] * (a.ndim - 2), mode="reflect" if min(a.shape[:2]) > 1 else "edge")
    smooth1 = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    smooth0 = p[:-2] + 2 * p[1:-1] + p[2:]
    return smooth1[2:] - smooth1[:-2], smooth0[:, 2:] - smooth0[:, :-2]


def gaussian_kernel(rows: int, columns: int, sigma_r: float = 0.0, sigma_c: float = 0.0):
    """Sums to 1; a deviation of 0 or less is a quarter of the size."""
    parts = []
    for n, s in ((rows, sigma_r), (columns, sigma_c)):
        s = s if s > 0 else 0.25 * n
        x = np.arange(n) - (n - 1) / 2
        parts.append(np.exp(-(x**2) / (2 * s * s)))
    out = np.outer(*parts)
    return out / out.sum()


def sat(a):
    """Summed-area table."""
    return a.cumsum(axis=0).cumsum(axis=1)


def unwrap(a, window, stride, padding=(0, 0), dilation=(1, 1), columns: bool = True):
    """Patches as columns (or rows), first along the first dimension."""
    a = np.pad(a, [(p, p) for p in padding] + [(0, 0)] * (a.ndim - 2))
    span = [d * (w - 1) + 1 for d, w in zip(dilation, window)]
    view = sliding_window_view(a, span, (0, 1))[:: stride[0], :: stride[1], ..., :: dilation[0], :: dilation[1]]
    view = np.moveaxis(view, (-2, -1), (0, 1))  # w0, w1, n0, n1, rest
    out = view.reshape(view.shape[0] * view.shape[1], view.shape[2] * view.shape[3], *view.shape[4:], order="F")
    return out if columns else out.swapaxes(0, 1)


def wrap(a, shape, window, stride, padding=(0, 0), dilation=(1, 1), columns: bool = True):
    """The inverse of unwrap; where patches overlap they add up."""
    a = a if columns else a.swapaxes(0, 1)
    counts = [(n + 2 * p - d * (w - 1) - 1) // s + 1 for n, p, d, w, s in zip(shape, padding, dilation, window, stride)]
    patches = a.reshape(*window, *counts, *a.shape[2:], order="F")
    out = np.zeros((*(n + 2 * p for n, p in zip(shape, padding)), *a.shape[2:]))
    for i in range(window[0]):
        for j in range(window[1]):
            x, y = i * dilation[0], j * dilation[1]
            out[x : x + counts[0] * stride[0] : stride[0], y : y + counts[1] * stride[1] : stride[1]] += patches[i, j]
    return out[padding[0] : padding[0] + shape[0], padding[1] : padding[1] + shape[1]]


def moments(a):
    """m00, m01, m10, m11, with x along the first dimension."""
    x, y = np.arange(a.shape[0])[:, None], np.arange(a.shape[1])
    return np.array([a.sum(), (x * a).sum(), (y * a).sum(), (x * y * a).sum()])


# colour --------------------------------------------------------------------------------------


def rgb2gray(a, r: float = 0.2126, g: float = 0.7152, b: float = 0.0722):
    return r * a[..., 0] + g * a[..., 1] + b * a[..., 2]


def gray2rgb(a, r: float = 1.0, g: float = 1.0, b: float = 1.0):
    return np.stack([a * r, a * g, a * b], axis=2)


def rgb2hsv(a):
    """All in 0 to 1."""
    r, g, b = (a[..., k] for k in range(3))
    top, low = a.max(axis=2), a.min(axis=2)
    d = top - low
    safe = np.where(d == 0, 1, d)
    h = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) / 6
    return np.stack([np.where(d == 0, 0, h % 1), np.where(top == 0, 0, d / np.where(top == 0, 1, top)), top], axis=2)


def hsv2rgb(a):
    h, s, v = (a[..., k] for k in range(3))
    k = (np.array([5, 3, 1]) + h[..., None] * 6) % 6
    return v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


#: Red and blue weights of the three standards.
YCC = {"601": (0.299, 0.114), "709": (0.2126, 0.0722), "2020": (0.2627, 0.0593)}


def rgb2ycbcr(a, standard: str = "601"):
    """For values in 0 to 1: Y in 16/255 to 235/255, the others about 128/255."""
    kr, kb = YCC[standard]
    y = kr * a[..., 0] + (1 - kr - kb) * a[..., 1] + kb * a[..., 2]
    cb, cr = (a[..., 2] - y) / (2 * (1 - kb)), (a[..., 0] - y) / (2 * (1 - kr))
    return np.stack([(16 + 219 * y) / 255, (128 + 224 * cb) / 255, (128 + 224 * cr) / 255], axis=2)


def ycbcr2rgb(a, standard: str = "601"):
    kr, kb = YCC[standard]
    y, cb, cr = (255 * a[..., 0] - 16) / 219, (255 * a[..., 1] - 128) / 224, (255 * a[..., 2] - 128) / 224
    r, b = y + 2 * (1 - kr) * cr, y + 2 * (1 - kb) * cb
    return np.stack([r, (y - kr * r - kb * b) / (1 - kr - kb), b], axis=2)


def color_space(a, to: str, source: str):
    """Between gray, rgb, hsv and ycbcr."""
    if to == source:
        return a
    rgb = {"rgb": lambda x: x, "gray": gray2rgb, "hsv": hsv2rgb, "ycbcr": ycbcr2rgb}[source](a)
    return {"rgb": lambda x: x, "gray": rgb2gray, "hsv": rgb2hsv, "ycbcr": rgb2ycbcr}[to](rgb)


def histogram(a, bins: int, low: float, high: float):
    """Counts; values out of range go to the first or last bin."""
    at = ((np.asarray(a).ravel() - low) / ((high - low) / bins)).astype(int).clip(0, bins - 1)
    return np.bincount(at, minlength=bins).astype(float)


def hist_equal(a, hist):
    """Values (whole numbers from 0) through the normalized running sum of a histogram."""
    upto = hist.ravel().real.cumsum()
    low, high = (upto.min(), upto.max()) if len(upto) else (0.0, 0.0)
    table = np.trunc((len(upto) - 1) * (upto - low) / (high - low if high > low else 1.0))
    return table[np.asarray(a).astype(int).clip(0, len(upto) - 1)]


# edges, diffusion, deconvolution, regions ------------------------------------------------------------


def canny(a, low: float = 0.1, high: float | None = None, fast: bool = False):
    """Edges (1 or 0). Thresholds are shares of the largest gradient; with high None, Otsu's method finds it and low is a share of it."""
    smooth = convolve(np.pad(a, 2, mode="edge"), gaussian_kernel(5, 5, 1.4, 1.4))[2:-2, 2:-2]
    dx, dy = sobel(smooth)
    size = np.abs(dx) + np.abs(dy) if fast else np.hypot(dx, dy)
    top = size.max() or 1.0
    angle = np.arctan2(dy, dx) % np.pi
    sector = np.floor((angle + np.pi / 8) / (np.pi / 4)).astype(int) % 4
    p = np.pad(size, 1)
    n0, n1 = size.shape
    near = lambda i, j: p[1 + i : 1 + i + n0, 1 + j : 1 + j + n1]
    ahead = np.choose(sector, [near(1, 0), near(1, 1), near(0, 1), near(-1, 1)])
    behind = np.choose(sector, [near(-1, 0), near(-1, -1), near(0, -1), near(1, -1)])
    thin = np.where((size >= ahead) & (size >= behind), size, 0)
    if high is None:
        counts, edges = np.histogram(thin, 256, (0, top))
        mids, total = (edges[:-1] + edges[1:]) / 2, counts.sum()
        w0, s0 = counts.cumsum(), (counts * mids).cumsum()
        w1, s1 = total - w0, s0[-1] - s0
        between = w0 * w1 * (s0 / np.maximum(w0, 1) - s1 / np.maximum(w1, 1)) ** 2
        upper = mids[between.argmax()]
        lower = low * upper
    else:
        upper, lower = high * top, low * top
    weak = thin >= lower
    weak[[0, -1]], weak[:, [0, -1]] = False, False
    parts = regions(weak, 8).astype(int)
    strong = np.unique(parts[weak & (thin >= upper)])
    return (weak & np.isin(parts, strong)).astype(float)


def anisotropic_diffusion(a, step: float, conductance: float, iterations: int, flux: str = "exponential", kind: str = "gradient"):
    """flux: exponential or quadratic; kind: gradient (Perona-Malik) or curvature (modified curvature diffusion).

    Between a pixel and its neighbour on an axis the squared gradient is that of their difference and of the other axis's central
    difference, averaged over both. Edges are clamped.
    """
    a = np.array(a, float)
    for _ in range(iterations):
        mean = sum(np.gradient(a, axis=k) ** 2 for k in (0, 1)).mean() if min(a.shape) > 1 else 0.0
        rate = 1 / max(2 * conductance * conductance * mean, 1e-12)
        p = np.pad(a, 1, mode="edge")
        total, climb, sink = np.zeros(a.shape), np.zeros(a.shape), np.zeros(a.shape)
        for axis in (0, 1):
            q = p if axis == 0 else p.T
            ahead = np.diff(q, axis=0)[:, 1:-1]  # between neighbours along the axis
            slope = (q[:, 2:] - q[:, :-2]) / 2
            square = ahead**2 + ((slope[1:] + slope[:-1]) / 2) ** 2
            share = np.exp(-square * rate) if flux == "exponential" or kind != "gradient" else 1 / (1 + square * rate)
            flow = ahead * share if kind == "gradient" else ahead / np.sqrt(1e-10 + square) * share
            parts = np.diff(flow, axis=0), np.maximum(ahead[1:], 0) ** 2 + np.minimum(ahead[:-1], 0) ** 2, np.minimum(ahead[1:], 0) ** 2 + np.maximum(ahead[:-1], 0) ** 2
            total, climb, sink = (t + (v if axis == 0 else v.T) for t, v in zip((total, climb, sink), parts))
        a = a + step * (total if kind == "gradient" else total * np.sqrt(np.where(total > 0, climb, sink)))
    return a


#: Fixed value: the largest prime factor of the sizes that transforms for deconvolution are padded to.
LARGEST_FACTOR = 13


def _smooth_size(n: int) -> int:
    """The least size from n on without prime factors above LARGEST_FACTOR."""
    rest = n
    for p in (2, 3, 5, 7, 11, 13):
        while rest % p == 0:
            rest //= p
    return n if rest == 1 else _smooth_size(n + 1)


def _padded(a, psf):
    """(a with its edges carried on to a size that holds a and psf, psf's spectrum, where a lies)."""
    sizes = [_smooth_size(n + m) for n, m in zip(a.shape, psf.shape)]
    room = [(s - n) // 2 for s, n in zip(sizes, a.shape)]
    wide = np.pad(np.asarray(a, float), [(r, s - n - r) for r, s, n in zip(room, sizes, a.shape)], mode="edge")
    spot = np.zeros(sizes)
    spot[tuple(slice(0, n) for n in psf.shape)] = psf
    spectrum = np.fft.fft2(np.roll(spot, [-(n // 2) for n in psf.shape], (0, 1)))
    return wide, spectrum, tuple(slice(r, r + n) for r, n in zip(room, a.shape))


def iterative_deconv(a, psf, iterations: int, relax: float = 0.05, method: str = "richardson_lucy"):
    wide, h, inside = _padded(a, psf)
    blur = lambda x, f: np.fft.ifft2(np.fft.fft2(x) * f).real
    x = wide
    for _ in range(iterations):
        x = x + relax * blur(wide - blur(x, h), h.conj()) if method == "landweber" else x * blur(wide / blur(x, h), h.conj())
    return x[inside]


def inverse_deconv(a, psf, gamma: float):
    """Tikhonov: conj(H) F / (|H|^2 + gamma), zero where the divisor is below gamma."""
    wide, h, inside = _padded(a, psf)
    power = np.abs(h) ** 2 + gamma
    return np.fft.ifft2(np.where(power >= gamma, h.conj() * np.fft.fft2(wide) / power, 0)).real[inside]


def confidence_cc(a, seeds, radius: int, multiplier: float, iterations: int, value: float = 1.0):
    """Pixels connected (8 ways) to the seeds (rows of x, y) within mean +- multiplier * deviation, and at least the seeds' own values.

    The statistics are those of the windows about the seeds, each counted by itself, then of the region, with the sample's variance.
    """
    seeds = tuple(np.asarray(seeds).real.astype(int).reshape(-1, 2).T)
    span = a.max() - a.min()
    image = (a - a.min()) / (span if span else 1.0)
    padded = np.pad(image, radius)
    near = sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1))[seeds].ravel()
    own = image[seeds]

    def grown(sample):
        mean, deviation = sample.mean(), sample.std(ddof=1) if len(sample) > 1 else 0.0
        low, high = min(mean - multiplier * deviation, own.min()), max(mean + multiplier * deviation, own.max())
        parts = regions((image >= low) & (image <= high), 8)
        return deviation**2 >= 1e-6, np.isin(parts, np.unique(parts[seeds])) & (parts > 0)

    varied, region = grown(near)
    for _ in range(iterations):
        if not varied or not region.any():
            break
        varied, region = grown(image[region])
    return np.where(region, value, 0.0)


def dog(a, radius1: int, radius2: int):
    """Difference of two Gaussian blurs of window 2 r + 1."""
    return np.subtract(*(convolve(a, gaussian_kernel(2 * r + 1, 2 * r + 1)) for r in (radius1, radius2)))


def separable_blur(a, sigma: float):
    n = 2 * int(np.ceil(3 * sigma)) + 1
    k = gaussian_kernel(n, 1, sigma, 1.0).ravel()
    p = n // 2
    if not p:
        return a
    padded = np.pad(a, p, mode="edge")
    # of convolve_sep(padded, k, k) the inner part alone, terms added in its order
    for axis, size in enumerate(a.shape):
        shape = (size, padded.shape[1]) if axis == 0 else a.shape
        out, term = np.zeros(shape, np.result_type(a, float)), np.empty(shape, np.result_type(a, float))
        for at in range(n):
            if k[at] != 0:
                part = slice(2 * p - at, 2 * p - at + size)
                out += np.multiply(padded[part] if axis == 0 else padded[:, part], k[at], out=term)
        padded = out
    return padded
