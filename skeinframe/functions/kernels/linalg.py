"""Factorizations and solvers."""

from __future__ import annotations

import numpy as np


def svd(a):
    """u, s, vt."""
    u, s, vt = np.linalg.svd(a)
    return u, s, vt


def lu(a):
    """lower (unit diagonal), upper, pivot (row of a that each row comes from), by partial pivoting."""
    a = np.array(a, complex if np.iscomplexobj(a) else float)
    rows, columns = a.shape
    k = min(rows, columns)
    pivot = np.arange(rows)
    for j in range(k):
        p = j + int(np.abs(a[j:, j]).argmax())
        if p != j:
            a[[j, p]], pivot[[j, p]] = a[[p, j]], pivot[[p, j]]
        if a[j, j] != 0:
            a[j + 1 :, j] /= a[j, j]
            a[j + 1 :, j + 1 :] -= np.outer(a[j + 1 :, j], a[j, j + 1 :])
    return np.tril(a[:, :k], -1) + np.eye(rows, k), np.triu(a[:k]), pivot


def lu_packed(a):
    """Both factors in one array, pivot."""
    lower, upper, pivot = lu(a)
    out = np.zeros(a.shape, upper.dtype)
    k = min(a.shape)
    out[:, :k] += np.tril(lower, -1)
    out[:k] += upper
    return out, pivot


def _triangular(a, b, lower: bool, unit: bool = False):
    x = np.array(b, np.result_type(a, b, float))
    n = a.shape[0]
    for i in range(n) if lower else range(n - 1, -1, -1):
        part = slice(0, i) if lower else slice(i + 1, n)
        x[i] -= a[i, part] @ x[part]
        if not unit:
            x[i] /= a[i, i]
    return x


def solve_lu(packed, pivot, b):
    k = pivot.ravel().real.astype(int)
    return _triangular(packed, _triangular(packed, b[k], True, True), False)


def qr(a):
    """q, r, tau (Householder factors)."""
    q, r = np.linalg.qr(a, mode="complete")
    h, tau = np.linalg.qr(a, mode="raw")
    return q, r, tau


def cholesky(a, upper: bool = False):
    """(factor, info): info is 0, or the order of the first leading minor that isn't positive; the factor holds what precedes it."""
    n = a.shape[0]
    out = np.zeros_like(a, complex if np.iscomplexobj(a) else float)
    info = 0
    for j in range(n):
        d = (a[j, j] - np.vdot(out[j, :j], out[j, :j])).real
        if d <= 0 or np.isnan(d):
            info = j + 1
            break
        out[j, j] = np.sqrt(d)
        out[j + 1 :, j] = (a[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j].conj()) / out[j, j]
    return (out.conj().T if upper else out), np.array([float(info)])


def solve(a, b, kind: str = "general"):
    """kind: general (least squares if not square), lower or upper."""
    if kind != "general":
        return _triangular(a, b, kind == "lower")
    return np.linalg.solve(a, b) if a.shape[0] == a.shape[1] else np.linalg.lstsq(a, b, rcond=None)[0]


def inverse(a):
    return np.linalg.inv(a)


def pinverse(a, tol: float = 1e-6):
    """Singular values up to tol * max(shape) * the largest count as zero."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > tol * max(a.shape) * (s.max() if len(s) else 0)
    return (vt[keep].conj().T / s[keep]) @ u[:, keep].conj().T


def _exact_rank(a) -> int:
    """By elimination in whole numbers: doubles are such, over a power of two."""
    ratios = [[x.as_integer_ratio() for x in row] for row in a.tolist()]
    over = max(d for row in ratios for _, d in row)
    left, done, last = [[n * (over // d) for n, d in row] for row in ratios], 0, 1
    for c in range(a.shape[1]):
        at = next((i for i in range(done, len(left)) if left[i][c]), None)
        if at is None:
            continue
        left[done], left[at] = left[at], left[done]
        top = left[done]
        for i in range(done + 1, len(left)):
            left[i] = [(top[c] * x - left[i][c] * y) // last for x, y in zip(left[i], top, strict=True)]  # divides without a rest
        done, last = done + 1, top[c]
    return done


def rank(a, tol: float | None = 1e-5):
    """Rows of R with an element above tol. tol None: the rank of the numbers as they are, however small; they must be finite."""
    if tol is None:
        a = np.asarray(a, float)
        some = a[np.ix_((a != 0).any(axis=1), (a != 0).any(axis=0))]
        if not some.size:
            return np.array([0.0])
        s = np.linalg.svd(some, compute_uv=False)
        # singular values are off by rounding alone: full rank is certain far above it, else whole numbers decide
        sure = s[-1] > 1e3 * max(some.shape) * np.finfo(float).eps * s[0]
        return np.array([float(min(some.shape) if sure else _exact_rank(some))])
    return np.array([float((np.abs(np.linalg.qr(a, mode="r")) > tol).any(axis=1).sum())])


def det(a):
    return np.array([np.linalg.det(a)])


def norm(a, kind: str = "vector_2", p: float = 1.0, q: float = 1.0):
    """kind: vector_1, vector_2, vector_inf, vector_p, matrix_1, matrix_inf, matrix_2, matrix_pq."""
    size = np.abs(a)
    match kind:
        case "vector_1":
            out = size.sum()
        case "vector_2":
            out = np.sqrt((size**2).sum())
        case "vector_inf":
            out = size.max()
        case "vector_p":
            out = (size**p).sum() ** (1 / p)
        case "matrix_1":
            out = size.sum(axis=0).max()
        case "matrix_inf":
            out = size.sum(axis=1).max()
        case "matrix_2":
            out = np.linalg.svd(a, compute_uv=False).max()
        case "matrix_pq":
            out = ((size**p).sum(axis=0) ** (q / p)).sum() ** (1 / q)
        case _:
            raise ValueError(f"no such norm: {kind}")
    return np.array([out])
