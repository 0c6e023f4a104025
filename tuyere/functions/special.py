"""Special functions in plain Python, for the few numbers (one per pair of columns) that need them."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for k in range(500):
        m = k // 2
        step = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)) if math.isfinite(t) else 0.0


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normal_inverse(p):
    """The standard normal quantile of a numpy array, by a rational starting value and Newton steps."""
    import numpy as np

    p = np.asarray(p, float)
    tail = np.minimum(p, 1 - p)
    r = np.sqrt(-2 * np.log(np.maximum(tail, 1e-300)))
    x = -(r - (2.30753 + 0.27061 * r) / (1 + 0.99229 * r + 0.04481 * r * r))  # a known approximation, good to 0.003
    for _ in range(4):
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x = x - (normal_share(x) - tail) / np.maximum(density, 1e-300)
    return np.where(np.isnan(p), np.nan, np.where(p < 0.5, x, -x))


def normal_share(x):
    """The standard normal distribution function of a numpy array that is not above 0 by much, by series and continued fraction."""
    import numpy as np

    x = np.asarray(x, float)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    term = total = np.where(np.abs(x) < 3, x, 0.0)
    for k in range(1, 80):
        term = term * np.where(np.abs(x) < 3, x, 0.0) ** 2 / (2 * k + 1)
        total = total + term
    far, f = np.maximum(np.abs(x), 3.0), np.zeros_like(x)
    for k in range(60, 0, -1):
        f = k / (far + f)
    outside = density / (far + f)
    return np.where(np.abs(x) < 3, 0.5 + density * total, np.where(x < 0, outside, 1 - outside))
