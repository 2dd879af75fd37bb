"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The number of eigenvalues above a shift is the number of positive pivots of an LDLᵀ factorisation of the shifted matrix (Sylvester's
law of inertia). Such counts halve intervals until each holds one eigenvalue; inverse iteration with the interval's midpoint finds
a vector whose residual keeps within the interval, and Rayleigh quotient iteration, which converges cubically, ends it. Counts
just above and below every value then certify its number. Eigenvalues that no shift can tell apart are taken together, as a
basis of their common subspace.
"""

from __future__ import annotations

import math

import numpy as np

EPSILON = float(np.finfo(np.float64).eps)
#: Bound of the growth of pivots for which a single pivot is taken.
_PIVOT = (1 + math.sqrt(17)) / 8
#: Eigenvalues closer than this part of the largest are one cluster.
CLUSTER = 1e-11


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above ``shift``: positive pivots of LDLᵀ, with pivots of one or two rows."""
    work = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(work):
        if len(work) == 1:
            return above + int(work[0, 0] > 0)
        column = np.abs(work[1:, 0])
        other = 1 + int(column.argmax())
        first, largest = abs(work[0, 0]), column[other - 1]
        size = 1
        if max(first, largest) == 0:
            work = work[1:, 1:]
            continue
        if first < _PIVOT * largest:
            row = np.abs(work[other])
            row[other] = 0
            beside = row.max()
            if first * beside < _PIVOT * largest * largest:
                size = 1 if abs(work[other, other]) >= _PIVOT * beside else 2
                swap, places = [size - 1, other], [other, size - 1]
                work[swap] = work[places]
                work[:, swap] = work[:, places]
        pivot, below, rest = work[:size, :size], work[size:, :size], work[size:, size:]
        if size == 1:
            above += int(pivot[0, 0] > 0)
            rest -= np.outer(below[:, 0], below[:, 0] / pivot[0, 0])
        else:
            above += 1  # such a pair of rows has one eigenvalue of each sign
            rest -= below @ np.linalg.solve(pivot, below.T)
        work = rest
    return above


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    """Shifted solution, scaled to orthonormal columns; a shift that hits an eigenvalue exactly is moved by a rounding error."""
    for times in (0, 1, 2, 4):
        try:
            found = np.linalg.solve(matrix - (shift + times * EPSILON * scale) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return np.linalg.qr(found)[0]
    raise ArithmeticError("no shift near the eigenvalue could be solved for")


class Slices:
    """Eigenvalues of one matrix, numbered from 1 by falling value."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.scale = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
        self.draw = np.random.default_rng(0)

    def count(self, shift: float) -> int:
        return count_above(self.matrix, shift)

    def isolated(self, needed: int) -> list[tuple[float, float, int, int]]:
        """Intervals (low, high, eigenvalues above high, eigenvalues above low) that hold one eigenvalue or a cluster."""
        top = self.scale * (1 + 8 * EPSILON)
        todo, out = [(-top, top, 0, len(self.matrix))], []
        while todo:
            low, high, before, upto = todo.pop()
            if before >= needed or before == upto:
                continue
            if upto - before == 1 or high - low <= CLUSTER * self.scale:
                out.append((low, high, before, upto))
                continue
            middle = (low + high) / 2
            at = self.count(middle)
            todo += [(low, middle, at, upto), (middle, high, before, at)]
        return out

    def single(self, low: float, high: float, number: int) -> tuple[float, np.ndarray]:
        """The eigenpair of an interval that holds just this eigenvalue."""
        vector = np.linalg.qr(self.draw.standard_normal((len(self.matrix), 1)))[0]
        value = math.inf
        while True:
            for _ in range(4):
                vector = _solve(self.matrix, (low + high) / 2, vector, self.scale)
                value, residual = self._quotient(vector)
                if low < value - residual and value + residual < high:
                    break
            else:
                if high - low > CLUSTER * self.scale:
                    middle = (low + high) / 2
                    low, high = (middle, high) if self.count(middle) >= number else (low, middle)
                    continue
            break
        for _ in range(12):
            if residual <= EPSILON * self.scale:
                break
            better = _solve(self.matrix, value, vector, self.scale)
            new_value, new_residual = self._quotient(better)
            if not new_residual < residual:
                break
            value, residual, vector = new_value, new_residual, better
        return value, vector

    def _quotient(self, vector: np.ndarray) -> tuple[float, float]:
        image = self.matrix @ vector
        value = float(vector[:, 0] @ image[:, 0])
        return value, float(np.linalg.norm(image - value * vector))

    def cluster(self, low: float, high: float, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and a basis for eigenvalues that are equal but for rounding."""
        basis = np.linalg.qr(self.draw.standard_normal((len(self.matrix), size)))[0]
        for _ in range(4):
            basis = _solve(self.matrix, high + (high - low), basis, self.scale)
        values, turn = np.linalg.eigh(basis.T @ self.matrix @ basis)
        return values[::-1], basis @ turn[:, ::-1]


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` leading eigenvalues of a positive semi-definite matrix, and their unit vectors as columns. Values that
    are zero but for rounding have no place in the result."""
    slices = Slices(matrix)
    size = len(matrix)
    least = 4 * size * EPSILON * slices.scale
    needed = min(most, slices.count(least)) if slices.scale else 0
    if not needed:
        return np.empty(0), np.empty((size, 0))
    numbered: dict[int, np.ndarray] = {}
    slack = max(CLUSTER, 16 * size * EPSILON) * slices.scale
    for low, high, before, upto in slices.isolated(needed):
        if upto - before == 1:
            value, vector = slices.single(low, high, upto)
            values, vectors = np.array([value]), vector
        else:
            values, vectors = slices.cluster(low, high, upto - before)
        # No more than ``before`` values lie above this one, and with it at least ``upto``.
        if slices.count(float(values[0]) + slack) > before or slices.count(float(values[-1]) - slack) < upto:
            raise ArithmeticError(f"eigenvalue {before + 1} failed its certificate")
        for i in range(upto - before):
            numbered[before + 1 + i] = vectors[:, i]
    found = np.array([numbered[k] for k in range(1, needed + 1)]).T
    basis, turn = np.linalg.qr(found)
    basis = basis * np.where(np.diag(turn) < 0, -1.0, 1.0)
    return np.einsum("ik,ij,jk->k", basis, matrix, basis), basis
