"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

``factor`` is a symmetric LDL' decomposition with Bunch-Kaufman pivots. By
Sylvester's law of inertia the signs of D for a shifted matrix count the eigenvalues
on either side of the shift. Bisection by such counts closes an interval around the
k-th largest eigenvalue until it is alone there, Rayleigh quotient iteration takes it
from there with cubic convergence, and counts on both sides certify its number.
Eigenvalues that agree to rounding can't be told apart; they get orthonormal vectors
of the space that they share.
"""

from __future__ import annotations

import math

import numpy as np

_ALPHA = (1 + math.sqrt(17)) / 8
EPS = np.finfo(float).eps


class Factor:
    """P A P' = L D L' with blocks of one or two on the diagonal of D."""

    def __init__(self, a: np.ndarray) -> None:
        a, n = a.copy(), len(a)
        self.order, self.blocks, k = np.arange(n), [], 0
        while k < n:
            pivot, width = k, 1
            below = np.abs(a[k + 1 :, k])
            if below.size and (most := below.max()) > 0 and abs(a[k, k]) < _ALPHA * most:
                r = k + 1 + int(below.argmax())
                other = np.abs(a[k:, r])
                other[r - k] = 0
                if abs(a[k, k]) * other.max() < _ALPHA * most * most:
                    pivot, width = r, 1 if abs(a[r, r]) >= _ALPHA * other.max() else 2
            to = k + width - 1
            if pivot != to:
                for x in (a, a.T, self.order):
                    x[[to, pivot]] = x[[pivot, to]]
            d, rest = a[k : k + width, k : k + width].copy(), a[k + width :, k : k + width]
            if width == 2 or d[0, 0] != 0:  # a zero alone has nothing below it
                low = rest / d[0, 0] if width == 1 else np.linalg.solve(d, rest.T).T
                a[k + width :, k + width :] -= low @ rest.T
                a[k + width :, k : k + width] = low
            self.blocks.append((k, d))
            k += width
        self.low = a

    def above(self) -> int:
        """The number of positive eigenvalues."""
        count = 0
        for _, d in self.blocks:
            if len(d) == 1:
                count += d[0, 0] > 0
            else:
                det = d[0, 0] * d[1, 1] - d[1, 0] * d[0, 1]
                count += 1 if det < 0 else 2 * (d[0, 0] + d[1, 1] > 0)
        return int(count)

    def solve(self, b: np.ndarray, least: float) -> np.ndarray:
        """x with A x = b; pivots under ``least`` count as that."""
        x = b[self.order].copy()
        for k, d in self.blocks:
            end = k + len(d)
            x[end:] -= self.low[end:, k:end] @ x[k:end]
        for k, d in self.blocks:
            if len(d) == 1:
                x[k] /= d[0, 0] if abs(d[0, 0]) > least else math.copysign(least, d[0, 0])
            else:
                x[k : k + 2] = np.linalg.solve(d, x[k : k + 2])
        for k, d in reversed(self.blocks):
            end = k + len(d)
            x[k:end] -= self.low[end:, k:end].T @ x[end:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` are larger than ``shift``."""
    return Factor(a - shift * np.eye(len(a))).above()


def _unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in others:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _from(a: np.ndarray, shift: float, found: list[np.ndarray], scale: float, seed: int, rayleigh: bool) -> tuple[float, np.ndarray]:
    """Inverse iteration at ``shift``, then (with ``rayleigh``) at the quotients themselves."""
    v = _unit(np.random.default_rng(seed).standard_normal(len(a)), found)
    eye, least = np.eye(len(a)), EPS * scale
    fixed = Factor(a - shift * eye)
    value = shift
    for step in range(40):
        v = _unit((Factor(a - value * eye) if rayleigh and step >= 3 else fixed).solve(v, least), found)
        value = float(v @ a @ v)
        if np.linalg.norm(a @ v - value * v) <= 4 * EPS * scale and (step >= 3 or not rayleigh):
            # One more step takes what is left of the neighbours out of the vector.
            v = _unit((Factor(a - value * eye) if rayleigh else fixed).solve(v, least), found)
            return float(v @ a @ v), v
    return value, v


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors in rows."""
    n = len(a)
    count = min(count, n)
    scale = float(np.abs(a).sum(1).max()) if n else 0.0
    if scale == 0:
        return np.zeros(count), np.eye(n)[:count]
    slack = 8 * n * EPS * scale
    values, found = [], []
    for k in range(1, count + 1):
        low, high = -scale - slack, scale + slack
        at_low, at_high = n, 0
        while True:
            if at_low == k and at_high == k - 1:
                value, v = _from(a, (low + high) / 2, found, scale, k, True)
                if low < value <= high:
                    break
            if high - low <= slack:  # not to be told from its neighbours
                value, v = _from(a, (low + high) / 2, found, scale, k, False)
                break
            middle = (low + high) / 2
            if (m := above(a, middle)) >= k:
                low, at_low = middle, m
            else:
                high, at_high = middle, m
        if above(a, value - slack) < k or above(a, value + slack) >= k:
            raise ArithmeticError(f"eigenvalue {k} isn't certified by the counts")
        values.append(value)
        found.append(v)
    return np.array(values), np.array(found)
