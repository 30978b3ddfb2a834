"""Leading eigenpairs of a small symmetric matrix by contour integration, in numpy.

An interval of the spectrum is enclosed by a circle. Quadrature of solves with the shifted matrix
along it filters a block of vectors down to the eigenvectors inside; a Rayleigh-Ritz step takes
the pairs out of what is left, and both are repeated until the residuals are as small as doubles
allow. How many eigenvalues an interval holds is known beforehand from the signs of the pivots
of two factorisations (inertia), so that none can be missed unnoticed.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # points on the upper half of a circle
BLOCK = 6  # eigenvalues of one interval at most, unless they are too close to be told apart
SPARE = 6  # vectors beyond the eigenvalues inside
SMALL = 1e-13  # residuals that count as none
PIVOT = (1 + np.sqrt(17)) / 8


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` are greater than ``shift``: the positive pivots of a - shift.

    Symmetric elimination with complete pivoting over blocks of one and two rows.
    """
    m = np.array(a, float) - shift * np.eye(len(a))
    positive = 0
    while len(m):
        n = len(m)
        diagonal = np.abs(np.diag(m))
        r = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[r] == 0 and off[p, q] == 0:
            break  # only zeros are left
        if diagonal[r] >= PIVOT * off[p, q]:
            rest = np.arange(n) != r
            d, column = m[r, r], m[rest, r]
            positive += d > 0
            m = m[np.ix_(rest, rest)] - np.outer(column, column) / d
        else:  # an indefinite block of two: one pivot of each sign
            rest = (np.arange(n) != p) & (np.arange(n) != q)
            block, columns = m[np.ix_([p, q], [p, q])], m[np.ix_(np.flatnonzero(rest), [p, q])]
            positive += 1
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        m = (m + m.T) / 2
    return int(positive)


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) from the top that hold the ``wanted`` largest and all equal to the last."""
    radius = float(np.abs(a).sum(axis=1).max()) or 1.0  # no eigenvalue is beyond
    least = 64 * np.finfo(float).eps * radius

    def halved(low: float, high: float, n_low: int, n_high: int) -> list[tuple[float, float, int]]:
        if n_low == n_high or n_high >= wanted:
            return []
        if n_low <= wanted and n_low - n_high <= BLOCK or high - low <= least:
            return [(low, high, n_low - n_high)]
        middle = (low + high) / 2
        n = above(a, middle)
        return halved(middle, high, n, n_high) + halved(low, middle, n_low, n)

    low, high = -1.01 * radius, 1.01 * radius
    return halved(low, high, above(a, low), above(a, high))


def _inside(a: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs within (low, high) of a matrix with entries up to 1.

    Eigenvalues just outside pass the filter almost whole. Where they are more than the block has
    vectors to spare, residuals stall, and the block is doubled: one as wide as the matrix holds all.
    """
    n = len(a)
    size = min(n, count + max(SPARE, count))
    centre, half = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - at)  # the upper half; the lower one is its mirror image
    points = centre + half * np.exp(1j * angle)
    random = np.random.default_rng(seed)
    block = random.standard_normal((n, size))
    best, best_error = None, np.inf
    while True:
        stalled = 0
        for turn in range(40):  # four or five are usual; the inertia check below judges the outcome
            filtered = np.zeros(block.shape)
            for z, t, w in zip(points, angle, weight):
                solved = np.linalg.solve(z * np.eye(n) - a, block.astype(complex))
                filtered += w / 2 * (half * np.exp(1j * t) * solved).real
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ a @ basis)
            vectors = basis @ turned
            near = np.argsort(np.maximum(low - values, values - high), kind="stable")[:count]  # those inside come first
            near = near[np.argsort(values[near])]
            error = float(np.abs(a @ vectors[:, near] - vectors[:, near] * values[near]).max())
            if error < best_error:
                best, best_error, stalled = (values[near], vectors[:, near]), error, 0
            else:
                stalled += 1
            if best_error < 1e-14 or turn >= 3 and stalled >= 2:
                break
            block = vectors
        if best_error < SMALL or block.shape[1] == n:
            return best
        block = np.hstack([vectors, random.standard_normal((n, min(n, 2 * block.shape[1]) - block.shape[1]))])


def leading(a: np.ndarray, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``wanted`` largest eigenvalues, falling.

    Each column's entry of largest size, the first among equals, is positive. Raises when the
    pairs found do not account for the inertia of the matrix.
    """
    wanted = min(wanted, len(a))
    if not wanted:
        return np.empty(0), np.empty((len(a), 0))
    size = max(float(np.abs(a).max()), np.finfo(float).tiny)
    a = (a / size + a.T / size) / 2
    parts = intervals(a, wanted)
    pairs = [_inside(a, low, high, count, seed + i) for i, (low, high, count) in enumerate(parts)]
    basis, _ = np.linalg.qr(np.hstack([v for _, v in pairs]))  # one basis: vectors of close values are made orthogonal
    values, turned = np.linalg.eigh(basis.T @ a @ basis)
    values, vectors = values[::-1], (basis @ turned)[:, ::-1]
    slack = 1e-9
    residual = float(np.abs(a @ vectors - vectors * values).max())
    missed = above(a, values[-1] + slack) - int((values > values[-1] + slack).sum())
    if residual > 1e-10 or missed or len(values) < wanted:
        raise ArithmeticError(f"eigenpairs are incomplete: residual {residual}, missed {missed}")
    values, vectors = values[:wanted], vectors[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values * size, vectors * np.where(signs == 0, 1.0, signs)
