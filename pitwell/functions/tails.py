"""Tail probabilities of the t, F and chi-square laws, vectorised over small arrays (no SciPy)."""

from __future__ import annotations

from math import lgamma

import numpy as np


def _gammaln(a: float) -> float:
    return lgamma(a)


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b) by the continued fraction (modified Lentz)."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_gammaln(a + b) - _gammaln(a) - _gammaln(b) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    t = np.asarray(t, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: np.ndarray, d1: float, d2: float) -> np.ndarray:
    f = np.maximum(np.asarray(f, float), 0)
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, k: float) -> float:
    """Upper tail by series or continued fraction of the incomplete gamma."""
    a, x = k / 2, max(float(x), 0.0) / 2
    if x == 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * np.exp(-x + a * np.log(x) - _gammaln(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return float(np.exp(-x + a * np.log(x) - _gammaln(a)) * h)
