import numpy as np
import pytest

from skeinframe.functions.kernels import counter_rng as R
from skeinframe.functions.kernels import image as I
from skeinframe.functions.kernels import linalg as L
from skeinframe.functions.kernels import signal as S
from skeinframe.functions.kernels import vision as V
from skeinframe.operators import dense

RNG = np.random.default_rng(0)
A = RNG.random((6, 6)) + 0.1


def test_factorizations():
    lower, upper, pivot = L.lu(A)
    np.testing.assert_allclose(lower @ upper, A[pivot])
    packed, pivot = L.lu_packed(A)
    b = RNG.random((6, 2))
    np.testing.assert_allclose(L.solve_lu(packed, pivot, b), np.linalg.solve(A, b))
    q, r, _ = L.qr(A[:, :4])
    np.testing.assert_allclose(q @ r, A[:, :4], atol=1e-12)
    spd = A @ A.T + np.eye(6)
    factor, info = L.cholesky(spd)
    np.testing.assert_allclose(factor @ factor.T, spd)
    assert info[0] == 0 and L.cholesky(np.diag([1.0, -1.0, 1.0]))[1][0] == 2
    np.testing.assert_allclose(L.solve(np.triu(A), b, "upper"), np.linalg.solve(np.triu(A), b))
    np.testing.assert_allclose(L.pinverse(A[:, :3]), np.linalg.pinv(A[:, :3]))
    assert L.rank(np.outer([1.0, 2, 3], [4.0, 5, 6]))[0] == 1
    near = np.diag([1.0, 1e-7, 1e-300, 0.0])  # without a tolerance a small value counts and a dependent column doesn't
    assert L.rank(near)[0] == 1 and L.rank(near, None)[0] == 3
    assert L.rank(np.array([[0.0, 3.0], [0.0, 4.0]]), None)[0] == 1 and L.rank(np.zeros((2, 3)), None)[0] == 0
    assert L.rank(np.array([[0.1, 0.2], [0.1, np.nextafter(0.2, 1)]]), None)[0] == 2
    for lu_of in (A[:4], A[:, :4]):
        lower, upper, pivot = L.lu(lu_of)
        np.testing.assert_allclose(lower @ upper, lu_of[pivot])


def test_transforms():
    for rank in (1, 2):
        np.testing.assert_allclose(S.ifft(S.fft(A, rank), rank), A, atol=1e-12)
        np.testing.assert_allclose(S.fft_c2r(S.fft_r2c(A, rank), rank, 1 / 6**rank), A, atol=1e-12)
    assert S.fft(A, sizes=[8]).shape == (8, 6)
    np.testing.assert_allclose(S.ifft(A, norm=1.0), np.fft.ifft(A, axis=0) * 6)


def test_convolutions():
    k = RNG.random((3, 2))
    np.testing.assert_allclose(S.fft_convolve(A, k, True), S.convolve(A, k, True), atol=1e-12)
    assert S.convolve(A, k).shape == A.shape
    np.testing.assert_allclose(S.convolve(A[:, 0], np.array([1.0, 2, 3]), True), np.convolve(A[:, 0], [1, 2, 3]))
    out = S.convolve_nn(A, k, (1, 1), (1, 1), (2, 1))
    eps = 1e-6
    g = RNG.random(out.shape)
    for by, x in (("data", A), ("filter", k)):
        grad = S.convolve_nn_gradient(g, A, k, by, (1, 1), (1, 1), (2, 1))
        bump = np.zeros_like(x)
        bump[1, 1] = eps
        moved = S.convolve_nn(A + bump, k, (1, 1), (1, 1), (2, 1)) if by == "data" else S.convolve_nn(A, k + bump, (1, 1), (1, 1), (2, 1))
        assert grad[1, 1] == pytest.approx(((moved - out) * g).sum() / eps, rel=1e-4)


def test_interpolation():
    x = np.arange(10.0) ** 2
    np.testing.assert_allclose(S.approx1(x, np.array([0.5, 3.25, 9.0, 9.01, -0.1]), "linear", -7.0), [0.5, 10.75, 81, -7, -7])
    np.testing.assert_allclose(S.approx1(x, np.array([3.5]), "spline"), [12.25])
    np.testing.assert_allclose(S.approx1(x, np.array([2.4, 2.6]), "nearest"), [4, 9])
    np.testing.assert_allclose(S.approx1(x, np.array([2.9]), "lower"), [4])
    plane = np.add.outer(np.arange(5.0), 2 * np.arange(4.0))
    np.testing.assert_allclose(S.approx2(plane, np.array([1.5]), np.array([2.25]), "bilinear"), [6.0])


def test_images():
    np.testing.assert_allclose(I.hsv2rgb(I.rgb2hsv(RNG.random((4, 5, 3)))).shape, (4, 5, 3))
    rgb = RNG.random((4, 5, 3))
    np.testing.assert_allclose(I.hsv2rgb(I.rgb2hsv(rgb)), rgb, atol=1e-12)
    for standard in I.YCC:
        np.testing.assert_allclose(I.ycbcr2rgb(I.rgb2ycbcr(rgb, standard), standard), rgb, atol=1e-12)
    np.testing.assert_allclose(I.wrap(I.unwrap(A, (2, 2), (2, 2)), (6, 6), (2, 2), (2, 2)), A)
    assert I.unwrap(A, (3, 3), (1, 1), (1, 1)).shape == (9, 36)
    assert I.gaussian_kernel(5, 7).sum() == pytest.approx(1)
    on = np.array([[1, 0, 1], [0, 1, 0], [1, 1, 0]])
    assert I.regions(on, 4).max() == 3 and I.regions(on, 8).max() == 1
    np.testing.assert_allclose(I.sat(A), A.cumsum(0).cumsum(1))
    neg = -np.ones((3, 3))
    assert I.dilate(neg, np.ones((3, 3)))[0, 0] == 0 and I.dilate(neg, np.ones((3, 3)))[1, 1] == -1 and I.erode(neg, np.ones((3, 3)))[0, 0] == -1
    np.testing.assert_allclose(I.rotate(A, 0.0), A)
    turned = I.rotate(A, np.pi / 2)
    assert any(np.allclose(turned, np.rot90(A, k)) for k in (1, -1))
    np.testing.assert_allclose(I.translate(A, 1, 0)[1:], A[:-1])
    flat = np.full((8, 8), 3.0)
    for f in (lambda a: I.bilateral(a, 2, 1), lambda a: I.mean_shift(a, 2, 1, 3), lambda a: I.anisotropic_diffusion(a, 0.1, 1, 3), lambda a: S.medfilt(a, (3, 3), "symmetric"), lambda a: I.resize(a, 8, 8, "bilinear")):
        np.testing.assert_allclose(f(flat), flat)
    step = np.zeros((20, 20))
    step[:, 10:] = 1
    edges = I.canny(step, 0.1, 0.3)
    assert set(np.nonzero(edges)[1]) <= {9, 10} and edges[2:-2].any(axis=1).all()
    np.testing.assert_allclose(I.inverse_deconv(flat, I.gaussian_kernel(3, 3), 1e-12), flat, atol=1e-6)
    np.testing.assert_allclose(I.iterative_deconv(flat, I.gaussian_kernel(3, 3), 4), flat, atol=1e-9)
    assert I.confidence_cc(step, [[5, 15]], 2, 2.0, 3).sum() == 200


def test_kernels_pixel_by_pixel():
    """Goldens from each operator's formula, one pixel at a time."""
    a = np.round(RNG.random((14, 13)) * 200)
    n0, n1 = a.shape
    # susan: centre included, strictly within the radius, strictly above all neighbours
    score = np.zeros(a.shape)
    for x in range(3, n0 - 3):
        for y in range(3, n1 - 3):
            like = sum(np.exp(-(((a[x + i, y + j] - a[x, y]) / 32) ** 6)) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j < 9)
            score[x, y] = max(12 - like, 0)
    want = {(x, y) for x in range(4, n0 - 4) for y in range(4, n1 - 4) if score[x, y] > max(score[x + i, y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)}
    got = V.susan(a, 3, 32.0, 12.0, 1.0)
    assert {(p["x"], p["y"]) for p in got} == want and all(p["score"] == pytest.approx(score[int(p["x"]), int(p["y"])]) for p in got)
    # templates: zeros beyond the edges, means over whole windows
    t = a[2:5, 3:7]
    pixel = lambda x, y: a[x, y] if x < n0 and y < n1 else 0.0
    for kind in ("sad", "zsad", "lsad", "ssd", "zssd", "lssd"):
        out = V.match_template(a, t, kind)
        for x, y in ((0, 0), (5, 6), (n0 - 1, n1 - 2)):
            part = np.array([[pixel(x + i, y + j) for j in range(4)] for i in range(3)])
            d = part - part.mean() - t + t.mean() if kind[0] == "z" else part - part.mean() / t.mean() * t if kind[0] == "l" else part - t
            assert out[x, y] == pytest.approx((abs(d) if kind.endswith("sad") else d * d).sum())
    # mean shift: places and colours without fractions
    out = I.mean_shift(a, 1.5, 60.0, 4)
    for x0, y0 in ((0, 0), (4, 4), (13, 12), (7, 2)):
        x, y, c = x0, y0, a[x0, y0]
        for _ in range(4):
            near = [(i, j) for i in range(max(x - 2, 0), min(x + 3, n0)) for j in range(max(y - 2, 0), min(y + 3, n1)) if (a[i, j] - c) ** 2 <= 3600]
            if not near:
                break
            i, j, m = int(np.mean([p for p, _ in near])), int(np.mean([q for _, q in near])), np.trunc(np.mean([a[p] for p in near]))
            moved, change = abs(i - x) + abs(j - y), (m - c) ** 2
            x, y, c = i, j, m
            if moved == 0 or moved + change <= 1:
                break
        assert out[x0, y0] == c
    # histogram: from the least of the running sums, fractions cut off
    hist = I.histogram(a, 256, 0, 256)
    upto = hist.cumsum()
    assert I.hist_equal(a, hist)[3, 3] == np.trunc(255 * (upto[int(a[3, 3])] - upto.min()) / (upto.max() - upto.min()))
    # diffusion, one step in the middle
    for flux in ("exponential", "quadratic"):
        k = 2 * 0.8**2 * (np.gradient(a, axis=0) ** 2 + np.gradient(a, axis=1) ** 2).mean()
        g = (lambda s: np.exp(-s / k)) if flux == "exponential" else (lambda s: 1 / (1 + s / k))
        x, y, change = 6, 5, 0.0
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            d = a[x + dx, y + dy] - a[x, y]
            cross = ((a[x + abs(dy), y + abs(dx)] - a[x - abs(dy), y - abs(dx)]) / 2 + (a[x + dx + abs(dy), y + dy + abs(dx)] - a[x + dx - abs(dy), y + dy - abs(dx)]) / 2) / 2
            change += d * g(d * d + cross * cross)
        assert I.anisotropic_diffusion(a, 0.1, 0.8, 1, flux)[x, y] == pytest.approx(a[x, y] + 0.1 * change)
    # deconvolution: a padded by its edges, then Richardson-Lucy by direct sums
    psf = I.gaussian_kernel(3, 3)
    wide, _, inside = I._padded(a, psf)
    assert wide.shape == (18, 16) and (wide[inside] == a).all() and wide[0, 0] == a[0, 0] and wide[-1, -1] == a[-1, -1]
    blur = sum(psf[i + 1, j + 1] * np.roll(wide, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1))
    back = sum(psf[i + 1, j + 1] * np.roll(wide / blur, (-i, -j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1))
    np.testing.assert_allclose(I.iterative_deconv(a, psf, 1), (wide * back)[inside])
    # confidence: windows counted each by itself, the sample's variance
    two = np.concatenate([a[2:5, 2:5].ravel(), a[3:6, 3:6].ravel()])
    low, high = two.mean() - two.std(ddof=1), two.mean() + two.std(ddof=1)
    out = I.confidence_cc(a, [[3, 3], [4, 4]], 1, 1.0, 0)
    assert out[3, 3] == out[4, 4] == 1 and all(low <= v <= high or v in (a[3, 3], a[4, 4]) or min(a[3, 3], a[4, 4]) <= v <= max(a[3, 3], a[4, 4]) for v in a[out > 0])


def test_vision():
    image = np.zeros((60, 60))
    image[20:40, 20:40] = 200
    corners = {(20, 20), (20, 39), (39, 20), (39, 39)}
    near = lambda found: all(min(abs(p["x"] - x) + abs(p["y"] - y) for x, y in corners) <= 4 for p in found)
    for found in (V.fast(image, 20.0), V.harris(image, 10), V.susan(image, 3, 32.0, 14.0)):
        assert found and near(found)
    assert V.match_template(A, A[2:4, 2:4], "ssd")[2, 2] == 0 and V.match_template(A, A[2:4, 2:4] + 5, "zsad")[2, 2] == pytest.approx(0)
    src = RNG.random((30, 2)) * 100
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 3], [1e-4, 2e-4, 1]])
    p = np.column_stack([src, np.ones(30)]) @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:6] += 50
    for kind in ("ransac", "lmeds"):
        got, inliers = V.homography(src, dst, kind, 1.0, 300)
        np.testing.assert_allclose(got, h, atol=1e-6)
        assert inliers[0] == 24
    picture = V.picture(RNG.random((8, 8)))
    assert all(len(f["descriptor"]) == n for f, n in ((V.orb(picture, 10.0, 20)[0], 8), (V.sift(picture)[0], 128), (V.gloh(picture)[0], 272)))


def test_counter_generators():
    """Known answers of Random123: Philox-4x32-10 and, of Threefry-2x32, agreement of whole and split streams."""
    zero = R.philox(np.zeros((1, 4), np.uint32), (0, 0))[0]
    assert [hex(x) for x in zero] == ["0x6627e8d5", "0xe169c58d", "0xbc57ac4c", "0x9b00dbd8"]
    ones = R.philox(np.full((1, 4), 0xFFFFFFFF, np.uint32), (0xFFFFFFFF, 0xFFFFFFFF))[0]
    assert [hex(x) for x in ones] == ["0x408f276d", "0x41c83b0e", "0xa20bc7c6", "0x6d5451fd"]
    assert [hex(x) for x in R.threefry(np.zeros((1, 2), np.uint32), (0, 0), 20)[0]] == ["0x6b200159", "0x99ba4efe"]
    i = np.arange(200_000, dtype=np.uint64)
    for kind in ("philox", "threefry", "mersenne"):
        u, z = R.uniform(i, 5, kind), R.normal(i, 5, kind)
        assert 0 < u.min() and u.max() <= 1 and abs(u.mean() - 0.5) < 3e-3 and abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
        np.testing.assert_array_equal(u[100:200], R.uniform(i[100:200], 5, kind))


def test_dense_rows(spark):
    arrays = [RNG.random((4, 4)) for _ in range(5)]
    df = dense.host(spark, arrays)
    out = dense.apply(df, ["a"], ["u", "s", "vt"], L.svd)
    for a, u, s, vt in zip(arrays, *(dense.collect(out, c) for c in ("u", "s", "vt"))):
        np.testing.assert_allclose(u @ np.diag(s) @ vt, a)
    z = dense.collect(dense.apply(df, ["a"], ["f"], lambda a: S.fft(a, 2)), "f")
    np.testing.assert_allclose(z[0], np.fft.fft2(arrays[0]))
    pair = dense.apply(df.withColumn("b", df["a"]), ["a", "b"], ["x"], L.solve)
    np.testing.assert_allclose(dense.collect(pair, "x")[0], np.eye(4), atol=1e-9)
    t = dense.to_tensor(df, [4, 4, 5])
    np.testing.assert_allclose(dense.collect(dense.from_tensor(t))[3], arrays[3])
