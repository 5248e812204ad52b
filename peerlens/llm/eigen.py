"""Eigenvalues and eigenvectors of a symmetric matrix: reduced to tridiagonal form, halved again and again, and put together by rank-one updates."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, beside it, q) with a = q t q', by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.sqrt(v @ v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, a[k + 1, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the tridiagonal matrix: that of two halves and of what couples them, which is of rank one."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m, rho = n // 2, e[n // 2 - 1]
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (d1, q1), (d2, q2) = conquer(upper, e[: m - 1]), conquer(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    return updated(np.r_[d1, d2], np.r_[q1[-1], q2[0]], rho, q)


def updated(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z') q'."""
    if rho < 0:
        values, vectors = updated(-d, z, -rho, q)
        return -values, vectors
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    length = np.sqrt(z @ z)
    if rho == 0 or length == 0:
        return d, q
    z, rho = z / length, rho * length * length
    left = deflated(d, z, rho, q)
    if left:
        d[left], turned = secular(d[left], z[left], rho)
        q[:, left] = q[:, left] @ turned
    return d, q


def deflated(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> list[int]:
    """Places that the update moves. Where z is negligible, or can be turned away between two nearly equal places, d and q change in place and are done."""
    least = 8 * EPS * (np.abs(d).max() + rho)
    left: list[int] = []
    for i in range(len(d)):
        if rho * abs(z[i]) <= least:
            continue
        if left:
            j, r = left[-1], np.hypot(z[left[-1]], z[i])
            c, s = z[i] / r, -z[left[-1]] / r
            if abs((d[i] - d[j]) * c * s) <= least:
                z[i], z[j] = r, 0.0
                q[:, j], q[:, i] = c * q[:, j] + s * q[:, i], c * q[:, i] - s * q[:, j]
                d[j], d[i] = c * c * d[j] + s * s * d[i], s * s * d[j] + c * c * d[i]
                left.pop()
        left.append(i)
    return left


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z' with d ascending, rho > 0 and no negligible z.

    Each root of 1 + rho sum z^2 / (d - x) = 0 lies between two poles; it is found by halving as the distance from the nearer one, so that differences to all poles
    keep their digits. The vectors are those of the z for which these roots are exact, which makes them orthogonal to working precision.
    """
    n, zz = len(d), z * z
    gaps = np.r_[np.diff(d), rho * zz.sum()]
    at = lambda origin, mu: 1 + rho * (zz[:, None] / ((d[:, None] - d[origin]) - mu)).sum(axis=0)
    i = np.arange(n)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        right = (at(i, gaps / 2) < 0) & (i < n - 1)
        origin = np.where(right, np.minimum(i + 1, n - 1), i)
        low, high = np.where(right, -gaps / 2, 0.0), np.where(right, 0.0, np.where(i < n - 1, gaps / 2, gaps))
        while True:
            mid = low + (high - low) / 2
            if not ((mid > low) & (mid < high)).any():
                break
            up = at(origin, mid) < 0
            low, high = np.where(up, mid, low), np.where(up, high, mid)
    mu = np.where(right, low, high)  # the end that isn't a pole
    away = (d[:, None] - d[origin]) - mu  # d_i - x_j
    between = d[:, None] - d
    np.fill_diagonal(between, 1.0)
    exact = np.copysign(np.sqrt(np.abs(np.prod(-away / between.T, axis=1) / rho)), z)
    vectors = exact[:, None] / away
    return d[origin] + mu, vectors / np.sqrt((vectors * vectors).sum(axis=0))


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns."""
    size = np.abs(a).max() if a.size else 0.0
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    values, vectors = conquer(d, e)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, (q @ vectors)[:, order]
