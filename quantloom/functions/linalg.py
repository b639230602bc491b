"""Small dense kernels, for per-date or per-rebalance systems of bounded size."""

from __future__ import annotations

import numpy as np


def ols(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Least squares coefficients."""
    return np.linalg.lstsq(x, y, rcond=None)[0]


def ols_residual(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Residuals of the complete rows, standardised by their population deviation; NaN for other rows, for all
    rows if fewer than columns + 1 are complete, and 0 where the residual is constant."""
    out = np.full(len(y), np.nan)
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    if ok.sum() < x.shape[1] + 1:
        return out
    r = y[ok] - x[ok] @ ols(y[ok], x[ok])
    sd = r.std()
    scale = max(1.0, float(np.abs(y[ok]).max()))
    out[ok] = 0.0 if sd <= 1e-12 * scale else r / sd
    return out


def ledoit_wolf(returns: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance (population) shrunk towards the mean variance on the diagonal, and the shrinkage."""
    x = returns - returns.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (((x**2).T @ (x**2)) / n - s**2).sum() / n / p)
    shrink = 0.0 if d2 == 0 else b2 / d2
    return (1 - shrink) * s + shrink * mu * np.eye(p), shrink


def ewma_cov(returns: np.ndarray, halflife: float) -> np.ndarray:
    """Exponentially weighted covariance around the weighted mean; the last row weighs most."""
    w = 0.5 ** (np.arange(len(returns))[::-1] / halflife)
    w /= w.sum()
    x = returns - w @ returns
    return (x * w[:, None]).T @ x


def nearest_psd(cov: np.ndarray) -> np.ndarray:
    v, q = np.linalg.eigh((cov + cov.T) / 2)
    return (q * np.maximum(v, 0)) @ q.T


def ridge_from_moments(n: float, sx: np.ndarray, sy: float, sxx: np.ndarray, sxy: np.ndarray, mean: np.ndarray, scale: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on features standardised by ``mean`` and ``scale``, from weighted moments: (coefficients of the
    raw features, intercept).  The penalty acts on the standardised ones, around the weighted means."""
    mx, my = sx / n, sy / n
    gram = (sxx - n * np.outer(mx, mx)) / np.outer(scale, scale)
    rhs = (sxy - n * mx * my) / scale
    beta = np.linalg.solve(gram + alpha * np.eye(len(mx)), rhs) / scale
    return beta, float(my - beta @ mx)


def inversions(rank: np.ndarray) -> int:
    """Pairs of places whose ranks (integers from 0) fall.  Two ranks differ first in one bit, and each bit is one pass:
    among ranks that agree above it, every zero is counted against the ones before it."""
    found = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        above = rank >> (bit + 1)
        order = np.argsort(above, kind="stable")
        above, one = above[order], (rank[order] >> bit) & 1
        upto = np.cumsum(one)
        start = np.searchsorted(above, above)
        found += int((upto - upto[start] + one[start])[one == 0].sum())
    return found


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Rank correlation from the number of inversions; NaN where a side is constant."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    tx = pairs(np.unique(x, return_counts=True)[1])
    ty = pairs(np.unique(y, return_counts=True)[1])
    txy = pairs(np.unique(np.stack([x, y]), axis=1, return_counts=True)[1])
    swaps = inversions(np.unique(y, return_inverse=True)[1])
    total = n * (n - 1) // 2
    if total in (tx, ty):
        return float("nan")
    return float((total - tx - ty + txy - 2 * swaps) / np.sqrt((total - tx) * (total - ty)))
