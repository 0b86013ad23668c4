"""Leading eigenpairs of a symmetric matrix.

Householder reflections make the matrix tridiagonal, bisection on Sturm counts finds the
largest eigenvalues, inverse iteration their vectors; within a cluster of close eigenvalues each
vector is made orthogonal to those before it.  The reflections bring the vectors back.
"""

from __future__ import annotations

import numpy as np

CLUSTER_GAP = 1e-3  # eigenvalues closer than this part of the matrix's norm are one cluster
SOLVES = 5
EPS = float(np.finfo(np.float64).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflection vectors) of a symmetric matrix."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    off, reflections = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        column = a[k + 1 :, k].copy()
        length = np.sqrt(column @ column)
        if k == n - 2 or not np.abs(column[1:]).any():
            off[k] = column[0]
            reflections.append(np.zeros(n - k - 1))
            continue
        off[k] = -np.copysign(length, column[0])
        column[0] -= off[k]
        v = column / np.sqrt(column @ column)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        reflections.append(v)
    return np.diag(a).copy(), off, reflections


def counts_below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each point."""
    squares = off * off
    least = max(np.finfo(np.float64).tiny, EPS * EPS * float(squares.max(initial=0.0)))
    q = diagonal[0] - points
    found = (q < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], squares, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - points - s / q
        found += q < 0
    return found


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection until no double lies between."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    margin = EPS * n * float((np.abs(diagonal) + reach).max()) + np.finfo(np.float64).tiny
    low = np.full(count, float((diagonal - reach).min()) - margin)
    high = np.full(count, float((diagonal + reach).max()) + margin)
    places = n - 1 - np.arange(count)  # how many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            return middle
        below = counts_below(diagonal, off, middle) <= places
        low, high = np.where(open_ & below, middle, low), np.where(open_ & ~below, middle, high)


def _factors(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Row-pivoted elimination of the shifted tridiagonal matrix, kept for several right sides."""
    n = len(diagonal)
    main, upper = (diagonal - shift).tolist(), off.tolist() + [0.0]
    second, lower, swapped = [0.0] * n, off.tolist(), [False] * n
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            swapped[i] = True
            main[i], upper[i], second[i], first = lower[i], main[i + 1], upper[i + 1], (main[i], upper[i])
            lower[i] = first[0] / main[i]
            main[i + 1], upper[i + 1] = first[1] - lower[i] * upper[i], -lower[i] * second[i]
        else:
            if abs(main[i]) < least:
                main[i] = least
            lower[i] /= main[i]
            main[i + 1] -= lower[i] * upper[i]
    if abs(main[-1]) < least:
        main[-1] = least
    return main, upper, second, lower, swapped


def _solve(factors, right: np.ndarray) -> np.ndarray:
    main, upper, second, lower, swapped = factors
    b = right.tolist()
    n = len(b)
    for i in range(n - 1):
        if swapped[i]:
            b[i], b[i + 1] = b[i + 1], b[i]
        b[i + 1] -= lower[i] * b[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            b[i] -= upper[i] * b[i + 1]
        if i + 2 < n:
            b[i] -= second[i] * b[i + 2]
        b[i] /= main[i]
    return np.array(b)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as rows, of falling eigenvalues."""
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), float(np.finfo(np.float64).tiny))
    found = np.zeros((len(values), n))
    rng = np.random.default_rng(17)
    cluster, shift_before = 0, None
    for k, value in enumerate(values.tolist()):
        shift = value
        if k and values[k - 1] - value > CLUSTER_GAP * norm:
            cluster = k
        elif k and shift >= shift_before - 10 * EPS * norm:
            shift = shift_before - 10 * EPS * norm  # equal shifts would give equal vectors
        shift_before = shift
        factors = _factors(diagonal, off, shift, EPS * norm)
        z = rng.uniform(-1.0, 1.0, n)
        for _ in range(SOLVES):
            z = z / np.abs(z).max()
            z = _solve(factors, z)
            z = z / np.abs(z).max()
            for _ in range(2):
                z -= found[cluster:k].T @ (found[cluster:k] @ z)
            z = z / np.sqrt(z @ z)
        found[k] = z
    return found


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as rows) of a symmetric matrix; at most ``count``.

    The entry of each vector that is largest by size is positive.  A matrix of zeros has the
    unit vectors.
    """
    n = len(matrix)
    count = min(count, n)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not count or scale == 0.0:
        return np.zeros(count), np.eye(count, n)
    diagonal, off, reflections = tridiagonal(np.asarray(matrix) / scale)
    values = largest_eigenvalues(diagonal, off, count)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        part = vectors[:, k + 1 :]
        part -= 2.0 * np.outer(part @ reflections[k], reflections[k])
    heads = np.abs(vectors).argmax(axis=1)
    signs = np.sign(vectors[np.arange(count), heads])
    return values * scale, vectors * signs[:, None]
