"""SQL of the queries over 8 x 8 arrays: each a query over (id, i, v), or (id, i, re, im), i being the column-major place of an element."""

from __future__ import annotations

import math

_I = "(generate_subscripts(embedding, 1) - 1)"
#: The arrays' elements: id, row x, column y, value v.
CELLS = f"(SELECT vec_id AS id, CAST({_I} % 8 AS INT) AS x, CAST({_I} // 8 AS INT) AS y, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
#: The same as 4 x 4 x 4 arrays, row by row.
CUBE = f"(SELECT id, (x * 8 + y) // 16 AS p, (x * 8 + y) // 4 % 4 AS q, (x * 8 + y) % 4 AS r, v FROM {CELLS})"
#: The same as images of three channels.
RGB = f"(SELECT a.id, a.x, a.y, abs(a.v) AS r, abs(b.v) AS g, abs(c.v) AS b FROM {CELLS} a JOIN {CELLS} b ON a.id = b.id AND a.x = b.y AND a.y = b.x JOIN {CELLS} c ON a.id = c.id AND c.x = 7 - a.x AND c.y = a.y)"
GRID = "(SELECT CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y FROM range(64) t(i))"
SAME = f"SELECT id, x + 8 * y AS i, v FROM {CELLS}"
SAME_CUBE = f"SELECT id, p + 4 * q + 16 * r AS i, v FROM {CUBE}"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows) + ")"


def transform(rank: int, half: bool = False) -> str:
    """The discrete Fourier transform along the first dimensions."""
    if rank == 3:
        n, names = 4, ("p", "q", "r")
        angle, place, keys = "2 * pi() * (k * p + l * q + m * r) / 4", "k + {0} * (l + 4 * m)", f"range({3 if half else 4}) a(k), range(4) b(l), range(4) c(m)"
        group, table = "k, l, m", CUBE
    elif rank == 2:
        angle, place, keys, group, table, n = "2 * pi() * (k * x + l * y) / 8", "k + {0} * l", f"range({5 if half else 8}) a(k), range(8) b(l)", "k, l", CELLS, 8
    else:
        angle, place, keys, group, table, n = "2 * pi() * k * x / 8", "k + {0} * y", f"range({5 if half else 8}) a(k)", "k, y", CELLS, 8
    return f"SELECT id, {place.format(n // 2 + 1 if half else n)} AS i, sum(v * cos({angle})) AS re, -sum(v * sin({angle})) AS im FROM {table}, {keys} GROUP BY id, {group}"


def filtered(kernel, x: str = "g.x + {0}", y: str = "g.y + {1}", grid: str = GRID, place: str = "g.x + 8 * g.y", table: str = CELLS) -> str:
    """Sums of kernel (offset in rows, in columns, weight) times the elements there; elements outside are zeros."""
    near = f"a.x = {x.format('k.i', 'k.j')} AND a.y = {y.format('k.i', 'k.j')}"
    return f"SELECT a.id, {place} AS i, sum(a.v * k.w) AS v FROM {table} a, {grid} g, {values(kernel)} k(i, j, w) WHERE {near} GROUP BY a.id, {place}"


def windows(aggregate: str, clamp: bool, radius: int = 1) -> str:
    """An aggregate of v (and of c, the centre, o and u, the offsets) over a square about each element; beyond the edges the nearest element, or nothing."""
    o = f"range(-{radius}, {radius + 1})"
    where = "a.x = greatest(0, least(7, g.x + o)) AND a.y = greatest(0, least(7, g.y + u))" if clamp else "a.x = g.x + o AND a.y = g.y + u"
    return f"SELECT id, x + 8 * y AS i, {aggregate} AS v FROM (SELECT g.id, g.x, g.y, g.v AS c, a.v, o, u FROM {CELLS} g, {o} s(o), {o} t(u), {CELLS} a WHERE a.id = g.id AND {where}) GROUP BY id, x, y"


def cubes(aggregate: str) -> str:
    o = "range(-1, 2)"
    return f"SELECT g.id, g.p + 4 * g.q + 16 * g.r AS i, {aggregate}(a.v) AS v FROM {CUBE} g, {CUBE} a WHERE a.id = g.id AND abs(a.p - g.p) <= 1 AND abs(a.q - g.q) <= 1 AND abs(a.r - g.r) <= 1 GROUP BY g.id, g.p, g.q, g.r"


CUBIC = ("-t * t * t + 2 * t * t - t", "t * t * t - 2 * t * t + 1", "-t * t * t + t * t + t", "t * t * t - t * t")
SPLINE = ("(-t * t * t + 2 * t * t - t) / 2", "(3 * t * t * t - 5 * t * t + 2) / 2", "(-3 * t * t * t + 4 * t * t + t) / 2", "(t * t * t - t * t) / 2")
LINEAR = ("0", "1 - t", "t", "0")


def along(weights, positions: str, count: int) -> str:
    """Interpolation along the rows; positions: of n, from 0 to count - 1."""
    shares = f"CASE o {' '.join(f'WHEN {k - 1} THEN {w}' for k, w in enumerate(weights))} END"
    points = f"(SELECT n, o, floor(p) + o AS spot, {shares} AS w FROM (SELECT n, {positions} AS p, {positions} - floor({positions}) AS t FROM range({count}) r(n)), range(-1, 3) s(o))"
    return f"SELECT id, n + {count} * y AS i, sum(w * v) AS v FROM {CELLS} a, {points} WHERE a.x = greatest(0, least(7, spot)) GROUP BY id, n, y"


def sampled(points: str, weights=LINEAR, off: float = 0.0) -> str:
    """Interpolation at points (i, px, py, inside), neighbours beyond the edges being the nearest element."""
    case = lambda o, t: f"CASE {o} {' '.join(f'WHEN {k - 1} THEN {w}' for k, w in enumerate(weights))} END".replace("t *", f"{t} *").replace("- t", f"- {t}").replace("+ t", f"+ {t}").replace("THEN t", f"THEN {t}").replace("* t", f"* {t}").replace("-t", f"-{t}")
    taps = f"(SELECT i, o, u, floor(px) + o AS ax, floor(py) + u AS ay, ({case('o', '(px - floor(px))')}) * ({case('u', '(py - floor(py))')}) AS w FROM ({points}), range(-1, 3) s(o), range(-1, 3) r(u) WHERE inside)"
    hits = f"SELECT id, i, sum(w * v) AS v FROM {CELLS} a, {taps} WHERE a.x = greatest(0, least(7, ax)) AND a.y = greatest(0, least(7, ay)) GROUP BY id, i"
    return f"SELECT e.id, p.i, coalesce(h.v, {off}) AS v FROM (SELECT vec_id AS id FROM embeddings) e CROSS JOIN (SELECT i FROM ({points})) p LEFT JOIN ({hits}) h ON h.id = e.id AND h.i = p.i"


def warped(m, rows: int, columns: int, nearest: bool = False) -> str:
    """The arrays seen through the affine map m (two rows of three) from the result's places."""
    (a, b, c), (d, e, f) = ([repr(float(v)) + "::DOUBLE" for v in row] for row in m)
    grid = f"(SELECT n % {rows} AS r, n // {rows} AS s, n AS i FROM range({rows * columns}) q(n))"
    spots = f"(SELECT i, {a} * r + {b} * s + {c} AS qx, {d} * r + {e} * s + {f} AS qy FROM {grid})"
    top = "floor({0} + 0.5)" if nearest else "{0}"
    px, py = top.format("greatest(qx, 0)"), top.format("greatest(qy, 0)")
    return sampled(f"SELECT i, {px} AS px, {py} AS py, qx >= -1e-4 AND qx < 8 AND qy >= -1e-4 AND qy < 8 AS inside FROM {spots}")


def gaussian(n: int, sigma: float | None = None):
    s = sigma or 0.25 * n
    rows = [(i, j, math.exp(-((i - (n - 1) / 2) ** 2 + (j - (n - 1) / 2) ** 2) / (2 * s * s))) for i in range(n) for j in range(n)]
    total = sum(w for *_, w in rows)
    return [(i - n // 2, j - n // 2, w / total) for i, j, w in rows]


_K3 = [(1 - i, 1 - j, float(a * b)) for i, a in enumerate((1, 2, 1)) for j, b in enumerate((1, 0, -1))]
_TAPS = [(i, 1 - j, float(a * b)) for i, a in enumerate((1, 2, 1)) for j, b in enumerate((1, 0, -1))]
_BACK = "(CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END)"
_REFLECT = {"x": _BACK.format("(g.x + {0})"), "y": _BACK.format("(g.y + {1})")}
CONV2 = filtered(_K3)
CONV3 = f"SELECT g.id, g.p + 4 * g.q + 16 * g.r AS i, sum(a.v) AS v FROM {CUBE} g, {CUBE} a WHERE a.id = g.id AND a.p - g.p IN (0, 1) AND a.q - g.q IN (0, 1) AND a.r - g.r IN (0, 1) GROUP BY g.id, g.p, g.q, g.r"
_FLIP = [(i, j, float(a * b)) for i, a in enumerate((1, 2, 1)) for j, b in enumerate((-1, 0, 1))]
_NN = f"(SELECT a.id, g.x, g.y, sum(a.v * k.w) AS v FROM {CELLS} a, {GRID} g, {values(_FLIP)} k(i, j, w) WHERE g.x < 6 AND g.y < 6 AND a.x = g.x + k.i AND a.y = g.y + k.j GROUP BY a.id, g.x, g.y)"


def product(left: str, right: str) -> str:
    """Of matrices (id, x, y, v)."""
    return f"(SELECT l.id, l.x, r.y, sum(l.v * r.v) AS v FROM {left} l JOIN {right} r ON l.id = r.id AND l.y = r.x GROUP BY l.id, l.x, r.y)"


_T = f"(SELECT id, y AS x, x AS y, v FROM {CELLS})"
GRAM = f"SELECT id, x + 8 * y AS i, v + CASE WHEN x = y THEN 4 ELSE 0 END AS v FROM {product(CELLS, _T)}"
EYE = f"SELECT id, x + 8 * y AS i, CASE WHEN x = y THEN 1.0 ELSE 0.0 END AS v FROM {CELLS}"
_HSV = f"(SELECT id, x, y, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d, r, g, b FROM {RGB})"
_HUE = "CASE WHEN d = 0 THEN 0 WHEN top = r THEN ((g - b) / d / 6) - floor((g - b) / d / 6) WHEN top = g THEN (2 + (b - r) / d) / 6 ELSE (4 + (r - g) / d) / 6 END"


def channels(*columns: str, table: str = RGB) -> str:
    return " UNION ALL ".join(f"SELECT id, x + 8 * y + {64 * k} AS i, {c} AS v FROM {table}" for k, c in enumerate(columns))


def _ycc(kr: float, kb: float) -> tuple[str, str, str]:
    y = f"({kr} * r + {1 - kr - kb} * g + {kb} * b)"
    return f"(16 + 219 * {y}) / 255", f"(128 + 224 * (b - {y}) / (2 * {1 - kb})) / 255", f"(128 + 224 * (r - {y}) / (2 * {1 - kr})) / 255"


def _rgb_of(kr: float, kb: float) -> tuple[str, str, str]:
    y, cb, cr = "((255 * r - 16) / 219)", "((255 * g - 128) / 224)", "((255 * b - 128) / 224)"
    red, blue = f"({y} + {2 * (1 - kr)} * {cr})", f"({y} + {2 * (1 - kb)} * {cb})"
    return red, f"({y} - {kr} * {red} - {kb} * {blue}) / {1 - kr - kb}", blue


def _hsv_channel(n: int) -> str:
    k = f"(({n} + r * 6) - 6 * floor(({n} + r * 6) / 6))"
    return f"b * (1 - g * greatest(0, least({k}, 4 - {k}, 1)))"


_VALUE = "CAST(trunc(greatest(0, least(255, v * 100 + 50))) AS INT)"
_BIN = "CAST(greatest(0, least(255, trunc(v * 100 + 50))) AS INT)"
HIST = f"""WITH c AS (SELECT id, x, y, {_VALUE} AS b, {_BIN} AS h FROM {CELLS}), n AS (SELECT e.vec_id AS id, CAST(bin AS INT) AS b, (SELECT count(*) FROM c WHERE c.id = e.vec_id AND c.h <= t.bin) AS upto FROM embeddings e, range(256) t(bin)),
    m AS (SELECT id, min(upto) AS low, max(upto) AS high FROM n GROUP BY id) SELECT c.id, x + 8 * y AS i, trunc(255.0::DOUBLE * (upto - low) / (high - low)) AS v FROM c JOIN n ON n.id = c.id AND n.b = c.b JOIN m ON m.id = c.id"""
REGIONS = f"""WITH RECURSIVE c AS (SELECT id, x, y, x + 8 * y AS i FROM {CELLS} WHERE v > 0), reach AS (SELECT id, i AS a, i AS b FROM c UNION
    SELECT r.id, r.a, d.i FROM reach r JOIN c ON c.id = r.id AND c.i = r.b JOIN c d ON d.id = c.id AND abs(d.x - c.x) <= 1 AND abs(d.y - c.y) <= 1),
    low AS (SELECT id, a, min(b) AS part FROM reach GROUP BY id, a), named AS (SELECT id, a, dense_rank() OVER (PARTITION BY id ORDER BY part) AS k FROM low)
    SELECT g.id, g.x + 8 * g.y AS i, coalesce(k, 0) AS v FROM {CELLS} g LEFT JOIN named n ON n.id = g.id AND n.a = g.x + 8 * g.y"""
UNWRAP = f"SELECT g.id, w.i + 3 * w.j + 9 * (g.x + 8 * g.y) AS i, coalesce(a.v, 0) AS v FROM {CELLS} g CROSS JOIN {values([(i, j) for i in range(3) for j in range(3)])} w(i, j) LEFT JOIN {CELLS} a ON a.id = g.id AND a.x = g.x + w.i - 1 AND a.y = g.y + w.j - 1"
TEMPLATE = f"SELECT g.id, g.x + 8 * g.y AS i, sum(pow(coalesce(a.v, 0) - t.v, 2)) AS v FROM {CELLS} g JOIN {CELLS} t ON t.id = g.id AND t.x BETWEEN 2 AND 4 AND t.y BETWEEN 2 AND 4 LEFT JOIN {CELLS} a ON a.id = g.id AND a.x = g.x + t.x - 2 AND a.y = g.y + t.y - 2 GROUP BY g.id, g.x, g.y"
_C, _S = math.cos(-0.4), math.sin(-0.4)
_M = [int(abs(8 * _C) + abs(8 * _S) + 0.5)] * 2
_TURN = [[round(v * 1000) / 1000 for v in (a, b, 3.5 - a * (_M[0] - 1) / 2 - b * (_M[1] - 1) / 2)] for a, b in ((_C, -_S), (_S, _C))]
_POINT = "SELECT n AS i, {0} * (n // {1}) AS px, {0} * (n % {1}) AS py, {0} * (n // {1}) <= 7 AND {0} * (n % {1}) <= 7 AS inside FROM range({2}) q(n)"

#: Real results.
REAL = {
    "ifft": SAME, "ifft2": SAME, "ifft3": SAME_CUBE, "fft_c2r": SAME, "fft2_c2r": SAME, "fft3_c2r": SAME_CUBE,
    "convolve2": CONV2, "convolve2_sep": CONV2, "fft_convolve2": CONV2, "convolve3": CONV3, "fft_convolve3": CONV3, "fft_convolve1": filtered([(1, 0, 1.0), (0, 0, 2.0), (-1, 0, 1.0)]),
    "convolve2_nn": filtered([(i - 1, j - 1, w) for i, j, w in _FLIP], "2 * g.x + {0}", "2 * g.y + {1}", "(SELECT n % 4 AS x, n // 4 AS y FROM range(16) q(n))", "g.x + 4 * g.y"),
    "convolve2_gradient_nn": filtered([(-i, -j, w) for i, j, w in _FLIP], table=_NN),
    "iir": f"SELECT a.id, g.x + 8 * g.y AS i, sum(a.v * CASE WHEN a.x = g.x THEN 1 ELSE pow(0.3::DOUBLE, g.x - a.x) + 0.5 * pow(0.3::DOUBLE, g.x - a.x - 1) END) AS v FROM {CELLS} a, {GRID} g WHERE a.y = g.y AND a.x <= g.x GROUP BY a.id, g.x, g.y",
    "medfilt2": windows("median(v)", True), "approx1_cubic": along(CUBIC, "n * 0.5", 14), "approx1_spline": along(SPLINE, "n * 0.5", 14), "approx1_uniform": along(LINEAR, "n * 0.5", 8),
    "approx2": sampled(_POINT.format("0.7::DOUBLE", 13, 169), off=-1.0), "approx2_bicubic": sampled(_POINT.format("0.7::DOUBLE", 10, 100), CUBIC),
    "svd": SAME, "lu": SAME, "qr": SAME, "cholesky": GRAM, "solve": SAME, "solve_lu": SAME, "solve_triangular": SAME, "inverse": EYE, "pinverse": SAME,
    "rank": f"SELECT id, 0 AS i, CAST(floor(abs(v) * 1000) AS INT) % 8 + 1 AS v FROM {CELLS} WHERE x = 0 AND y = 0", "det": f"SELECT id, 0 AS i, product(v) AS v FROM {CELLS} WHERE x = y GROUP BY id",
    "norm_matrix_2": f"SELECT a.id, 0 AS i, a.s * b.s AS v FROM (SELECT id, sqrt(sum(t * t)) AS s FROM (SELECT id, sum(v) AS t FROM {CELLS} GROUP BY id, x) GROUP BY id) a JOIN (SELECT id, sqrt(sum(t * t)) AS s FROM (SELECT id, sum(v) AS t FROM {CELLS} GROUP BY id, y) GROUP BY id) b ON a.id = b.id",
    "resize": sampled("SELECT n AS i, least(7, (n % 12) * 8.0::DOUBLE / 12) AS px, least(7, (n // 12) * 8.0::DOUBLE / 5) AS py, TRUE AS inside FROM range(60) q(n)"),
    "transform": warped([[1, -0.1, 0.5], [0.1, 1, 0]], 8, 8), "rotate": warped(_TURN, *_M), "translate": warped([[1, 0, -1], [0, 1, -2]], 8, 8, True), "scale": warped([[0.5, 0, 0], [0, 2, 0]], 16, 4, True),
    "skew": warped([[1, math.tan(0.1), 0], [math.tan(0.2), 1, 0]], 8, 8, True),
    "transform_coordinates": f"SELECT a.id, k.n + 4 * m AS i, CASE m WHEN 0 THEN k.x - b.v * k.y + 0.5 ELSE a.v * k.x + k.y END AS v FROM {CELLS} a JOIN {CELLS} b ON a.id = b.id AND a.x = 0 AND a.y = 0 AND b.x = 1 AND b.y = 0, {values([(0, 0, 0), (1, 0, 8), (2, 8, 8), (3, 8, 0)])} k(n, x, y), range(2) t(m)",
    "dilate": windows("CASE WHEN count(*) < 9 THEN greatest(max(v), 0) ELSE max(v) END", False), "maxfilt": windows("CASE WHEN count(*) < 9 THEN greatest(max(v), 0) ELSE max(v) END", False), "erode": windows("min(v)", True), "minfilt": windows("min(v)", True),
    "dilate3": cubes("max"), "erode3": cubes("min"),
    "bilateral": windows("sum(exp((o * o + u * u) / -4.5 + (c - v) * (c - v) / -0.08) * v) / sum(exp((o * o + u * u) / -4.5 + (c - v) * (c - v) / -0.08))", True, 2), "regions": REGIONS,
    "rgb2gray": f"SELECT id, x + 8 * y AS i, 0.2126 * r + 0.7152 * g + 0.0722 * b AS v FROM {RGB}", "gray2rgb": channels("0.5 * v", "0.3 * v", "0.2 * v", table=CELLS),
    "rgb2hsv": channels(_HUE, "CASE WHEN top = 0 THEN 0 ELSE d / top END", "top", table=_HSV), "hsv2rgb": channels(*map(_hsv_channel, (5, 3, 1))), "rgb2ycbcr": channels(*_ycc(0.299, 0.114)), "ycbcr2rgb": channels(*_rgb_of(0.2126, 0.0722)),
    "color_space": f"SELECT id, x + 8 * y AS i, 0.2126 * r2 + 0.7152 * g2 + 0.0722 * b2 AS v FROM (SELECT id, x, y, {', '.join(f'{c} AS {n}' for c, n in zip(_rgb_of(0.299, 0.114), ('r2', 'g2', 'b2')))} FROM {RGB})",
    "hist_equal": HIST, "unwrap": UNWRAP, "wrap": f"SELECT id, x + 8 * y AS i, v * CASE WHEN x IN (0, 7) THEN 2 ELSE 3 END * CASE WHEN y IN (0, 7) THEN 2 ELSE 3 END AS v FROM {CELLS}",
    "gaussian_kernel": f"SELECT id, k AS i, w / sum(w) OVER (PARTITION BY id) AS v FROM (SELECT id, k, exp(-pow(k % 5 - 2, 2) / (2 * pow(1 + abs(v), 2)) - pow(k // 5 - 1, 2) / (2 * 0.75 * 0.75)) AS w FROM {CELLS}, range(15) t(k) WHERE x = 0 AND y = 0)",
    "image_moments": f"SELECT id, k AS i, sum(v * CASE k WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN y ELSE x * y END) AS v FROM {CELLS}, range(4) t(k) GROUP BY id, k", "dog": filtered([*gaussian(3), *[(i, j, -w) for i, j, w in gaussian(5)]]), "match_template": TEMPLATE,
}
#: Complex results.
COMPLEX = {"fft": transform(1), "fft2": transform(2), "fft3": transform(3), "fft_r2c": transform(1, True), "fft2_r2c": transform(2, True), "fft3_r2c": transform(3, True)}
_SLOPE = "SELECT id, {0} AS i, CASE WHEN {1} = 0 THEN lead(v) OVER w - v WHEN {1} = 7 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS v FROM {2} WINDOW w AS (PARTITION BY id, {3} ORDER BY {1})"
_SMOOTH = [(a, b, float(a * w)) for a in (-1, 1) for b, w in ((-1, 1), (0, 2), (1, 1))]
#: Results of two parts.
PARTS = {
    "image_gradient": {"dx": _SLOPE.format("x + 8 * y", "x", CELLS, "y"), "dy": _SLOPE.format("x + 8 * y", "y", CELLS, "x")},
    "sobel": {"dx": filtered(_SMOOTH, **_REFLECT), "dy": filtered([(b, a, w) for a, b, w in _SMOOTH], **_REFLECT)},
}
