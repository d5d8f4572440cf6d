"""Eigenpairs of a symmetric matrix in given intervals by contour integration (FEAST).

The matrix is small (as wide as a vector is long); how it came about is not the matter of this module.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues sought by one contour, nodes of the quadrature on half a circle, and rounds it may take.
SLICE, NODES, ROUNDS = 12, 8, 30
#: A slice's upper border over its lower one, at most: wider circles let in too much of what is close to zero.
WIDTH = 4.0
#: Part of the largest eigenvalue below which one cannot be told from zero at the accuracy needed.
FLOOR = 1e-11
_PIVOT = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues larger than ``shift``: positive pivots of a symmetric factorisation with 1x1 and 2x2 blocks."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        wide = 1
        if most and abs(a[k, k]) < _PIVOT * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < _PIVOT * most**2:
                if abs(a[r, r]) >= _PIVOT * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    wide = 2
        if wide == 1:
            pivot = a[k, k]
            positive += pivot > 0
            if pivot:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / pivot)
        else:  # one positive and one negative eigenvalue
            positive += 1
            block, rest = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        k += wide
    return positive


def _filtered(matrix: np.ndarray, guess: np.ndarray, low: float, high: float) -> np.ndarray:
    """``guess`` projected towards the eigenvectors between ``low`` and ``high``: a quadrature of shifted solves."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    total = np.zeros_like(guess)
    for node, weight in zip(nodes, weights):
        turn = np.exp(-0.5j * np.pi * (node - 1))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, guess.astype(complex))
        total += weight / 2 * (radius * turn * solved).real
    return total


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz pairs of the space that ``basis`` spans."""
    left, sizes, _ = np.linalg.svd(basis, full_matrices=False)
    left = left[:, sizes > sizes.max() * 1e-13]
    values, turned = np.linalg.eigh(left.T @ matrix @ left)
    return values, left @ turned


def between(matrix: np.ndarray, low: float, high: float, count: int, accuracy: float = 64 * np.finfo(float).eps) -> np.ndarray:
    """An orthonormal basis of the ``count`` eigenvectors in an interval, for a matrix of norm about 1."""
    size, last = len(matrix), np.inf
    vectors = np.random.default_rng(42).normal(size=(size, min(size, 2 * count + 4)))
    for _ in range(ROUNDS):
        values, vectors = _ritz(matrix, _filtered(matrix, vectors, low, high))
        apart = np.abs(matrix @ vectors - vectors * values).max(axis=0)
        # Values inside that belong to no eigenvector can come up beside the true ones; they do not converge.
        true = (values > low) & (values < high) & (apart <= 1e3 * accuracy)
        worst = apart[true].max(initial=0.0)
        if true.sum() == count and (worst <= accuracy or worst >= last / 2):
            return vectors[:, true]
        last = worst if true.sum() == count else np.inf
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, {true.sum()} of them were found")


def _gap(matrix: np.ndarray, low: float, high: float) -> tuple[float, int]:
    """A border between ``low`` and ``high`` that has no eigenvalue close by, and the eigenvalues above it."""
    middle = np.sqrt(low * high) if high > WIDTH * low else (low + high) / 2
    for share in (1e-2, 1e-4, 1e-6):
        for part in (0.0, 0.05, -0.05, 0.1, -0.1, 0.2, -0.2, 0.3, -0.3, 0.4, -0.4):
            border = middle + part * (high - middle if part > 0 else middle - low)
            near = share * min(high - border, border - low)
            count = above(matrix, border + near)
            if count == above(matrix, border - near):
                return border, count
    return middle, -1


def _slices(matrix, low, n_low, high, n_high, most):
    """Intervals from high to low with the eigenvalues in each, until ``most`` or all above ``low`` are covered."""
    inside = n_low - n_high
    if inside <= 0 or n_high >= most:
        return
    if inside <= SLICE and n_low <= most and high <= WIDTH * low:
        yield low, high, inside
        return
    border, n = _gap(matrix, low, high)
    if n < 0 or high - low < 1e-9 * high:  # a cluster that no border parts is taken whole
        yield low, high, inside
        return
    yield from _slices(matrix, border, n, high, n_high, most)
    yield from _slices(matrix, low, n_low, border, n, most)


def largest(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` positive eigenvalues, falling, and their unit eigenvectors as columns.

    The spectrum is cut into slices whose numbers of eigenvalues are known from inertia counts, each is found by its
    own contour, and a last Rayleigh-Ritz step over all of them parts neighbours across the borders. A slice that does
    not yield as many as counted raises. Eigenvalues below ``FLOOR`` times the norm are taken for zero.
    """
    norm = float(np.linalg.norm(matrix)) if matrix.size else 0.0
    if not norm:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled, low, high = matrix / norm, FLOOR, 2.0
    found = [between(scaled, a, b, n) for a, b, n in _slices(scaled, low, above(scaled, low), high, 0, most)]
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values, vectors = _ritz(scaled, np.hstack(found))
    order = np.argsort(-values)[:most]
    return values[order] * norm, vectors[:, order]
