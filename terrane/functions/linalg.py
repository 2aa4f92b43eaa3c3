"""Small symmetric systems, many at a time."""

from __future__ import annotations

import numpy as np


def solve(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x with m x = r for each of n systems; r is (n, p, q). A singular system gets a ridge, then the pseudo-inverse."""
    try:
        out = np.linalg.solve(m, r)
    except np.linalg.LinAlgError:
        out = np.stack([_alone(a, b) for a, b in zip(m, r)]) if len(m) else r
    bad = ~np.isfinite(out).all((1, 2))
    for i in np.flatnonzero(bad):
        out[i] = _alone(m[i], r[i])
    return out


def _alone(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    p = len(m)
    for a in (m, m + (1e-6 * (np.trace(m) / p + 1e-12) + 1e-12) * np.eye(p)):
        try:
            x = np.linalg.solve(a, r)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    return np.linalg.pinv(m) @ r


def regular(m: np.ndarray) -> np.ndarray:
    """Which of n moment matrices have full rank, told by their eigenvalues."""
    finite = np.isfinite(m).all((1, 2))
    out = np.zeros(len(m), bool)
    if finite.any():
        values = np.linalg.eigvalsh(m[finite])
        out[finite] = values[:, 0] > 1e-14 * np.maximum(values[:, -1], 0)
    return out
