"""Mean-variance programs by operator splitting (ADMM).

minimise  risk * w'Cw - alpha'w + cost'|w - w0|
subject to  low <= w <= high, sum w = net, min_gross <= sum |w| <= max_gross, groups within bounds.

The covariance may be dense or given by factors, C = B F B' + diag(D); then the linear systems are
solved by the Woodbury identity and no n x n matrix is formed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Constraints:
    """Bounds of a portfolio; scalars or one value for each asset."""

    n_assets: int
    long_only: bool = True
    min_weight: float | np.ndarray | None = None
    max_weight: float | np.ndarray | None = None
    net_exposure: float | None = 1.0
    min_gross: float | None = None
    max_gross: float | None = None
    sector_ids: np.ndarray | None = None
    sector_limits: dict[int, tuple[float, float]] = field(default_factory=dict)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(self.n_assets, 0.0 if self.long_only else -1.0) if self.min_weight is None else np.broadcast_to(np.asarray(self.min_weight, float), self.n_assets).copy()
        high = np.ones(self.n_assets) if self.max_weight is None else np.broadcast_to(np.asarray(self.max_weight, float), self.n_assets).copy()
        if self.long_only:
            low = np.maximum(low, 0.0)
        return low, high


@dataclass
class Solution:
    weights: np.ndarray
    converged: bool
    iterations: int
    objective: float
    residual: float


class Factored:
    """Covariance of a factor model without its dense form."""

    def __init__(self, loadings: np.ndarray, factor_cov: np.ndarray, specific: np.ndarray):
        self.b, self.f, self.d = loadings, factor_cov, specific

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.b @ (self.f @ (self.b.T @ w)) + self.d * w

    def solver(self, scale: float, shift: float):
        """Solve (scale * C + shift * I) x = r."""
        inv = 1 / (scale * self.d + shift)
        v, q = np.linalg.eigh((self.f + self.f.T) / 2)
        half = self.b @ (q * np.sqrt(np.maximum(v, 0) * scale))
        core = np.linalg.inv(np.eye(half.shape[1]) + half.T @ (inv[:, None] * half))
        return lambda r: inv * r - inv * (half @ (core @ (half.T @ (inv * r))))


class Dense(Factored):
    def __init__(self, cov: np.ndarray):
        self.c = (cov + cov.T) / 2

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.c @ w

    def solver(self, scale: float, shift: float):
        v, q = np.linalg.eigh(self.c)
        g = 1 / (scale * np.maximum(v, 0) + shift)
        return lambda r: q @ (g * (q.T @ r))


def _onto_l1(v: np.ndarray, radius: float) -> np.ndarray:
    if np.abs(v).sum() <= radius:
        return v
    u = np.sort(np.abs(v))[::-1]
    c = np.cumsum(u) - radius
    k = np.flatnonzero(u - c / np.arange(1, len(u) + 1) > 0)[-1]
    return np.sign(v) * np.maximum(np.abs(v) - c[k] / (k + 1), 0)


def solve(alpha: np.ndarray, cov: np.ndarray | Factored, spec: Constraints, risk: float = 1.0, w0: np.ndarray | None = None, cost: np.ndarray | float | None = None, max_iter: int = 20_000, tol: float = 1e-9) -> Solution:
    """Each constraint has a copy of the weights on which it is easy to project; the copies are driven to agree."""
    n = spec.n_assets
    c = cov if isinstance(cov, Factored) else Dense(np.asarray(cov, float))
    low, high = spec.bounds()
    w0 = np.zeros(n) if w0 is None else np.asarray(w0, float)
    price = np.zeros(n) if cost is None else np.broadcast_to(np.asarray(cost, float), n)
    groups = [] if spec.sector_ids is None else [(np.flatnonzero(spec.sector_ids == g), lo, hi) for g, (lo, hi) in spec.sector_limits.items()]

    def box_net(v: np.ndarray) -> np.ndarray:
        if spec.net_exposure is None:
            return np.clip(v, low, high)
        a, b = float((v - high).min()) - 1, float((v - low).max()) + 1
        for _ in range(80):
            m = (a + b) / 2
            a, b = (m, b) if np.clip(v - m, low, high).sum() > spec.net_exposure else (a, m)
        return np.clip(v - (a + b) / 2, low, high)

    def gross(v: np.ndarray) -> np.ndarray:
        if spec.max_gross is not None:
            v = _onto_l1(v, spec.max_gross)
        if spec.min_gross is not None and (short := spec.min_gross - np.abs(v).sum()) > 0:
            v = v + np.where(v >= 0, 1, -1) * short / n
        return v

    def sectors(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for at, lo, hi in groups:
            s = v[at].sum()
            v[at] += (np.clip(s, lo, hi) - s) / max(len(at), 1)
        return v

    parts = [box_net]
    if spec.max_gross is not None or spec.min_gross is not None:
        parts.append(gross)
    if groups:
        parts.append(sectors)
    shrink = bool(np.any(price > 0))
    copies = len(parts) + shrink
    trace = float(np.trace(c.c)) if isinstance(c, Dense) else float(c.d.sum() + np.einsum("ij,jk,ik->", c.b, c.f, c.b))
    rho = max(1e-6, 2 * risk * trace / n, float(np.abs(alpha).mean()) * 0.5)
    inverse = c.solver(2 * risk, rho * copies)
    z = np.tile(box_net(np.full(n, (spec.net_exposure or 0.0) / n)), (copies, 1))
    u = np.zeros_like(z)
    residual, done = np.inf, 0
    for done in range(1, max_iter + 1):
        w = inverse(alpha + rho * (z - u).sum(axis=0))
        old = z.copy()
        for i, p in enumerate(parts):
            z[i] = p(w + u[i])
        if shrink:
            v = w + u[-1] - w0
            z[-1] = w0 + np.sign(v) * np.maximum(np.abs(v) - price / rho, 0)
        u += w - z
        if done % 10 == 0:
            primal, dual = float(np.abs(w - z).max()), float(np.abs(z - old).max())
            residual = max(primal, dual)
            if residual < tol:
                break
            factor = 2.0 if primal > 10 * dual else 0.5 if dual > 10 * primal else 1.0
            if factor != 1.0 and done % 100 == 0 and done < max_iter // 2:
                rho *= factor
                u /= factor
                inverse = c.solver(2 * risk, rho * copies)
    w = z[0]
    value = float(alpha @ w - risk * w @ c.times(w) - price @ np.abs(w - w0))
    return Solution(w, residual < max(tol, 1e-6), done, value, residual)
