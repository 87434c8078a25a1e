"""Special functions and Student-t distributions in numpy."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x: np.ndarray | float) -> np.ndarray:
    return _lgamma(x)


def digamma(x: np.ndarray | float) -> np.ndarray:
    """By recurrence up to 10 and the asymptotic series, for x > 0."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))
    return out + np.log(x) - 0.5 / x - series


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by a continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = (xx > 0) & (xx < 1)
    z = np.where(inner, xx, 0.5)
    front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(z) + bb * np.log1p(-z)) / aa
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 / np.where(np.abs(1 - (aa + bb) * z / (aa + 1)) < tiny, tiny, 1 - (aa + bb) * z / (aa + 1))
    f = d.copy()
    for m in range(1, 200):
        for step in (
            m * (bb - m) * z / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * z / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1 / np.where(np.abs(1 + step * d) < tiny, tiny, 1 + step * d)
            c = np.where(np.abs(1 + step / c) < tiny, tiny, 1 + step / c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 2e-15):
            break
    value = np.where(inner, front * f, np.where(xx >= 1, 1.0, 0.0))
    return np.where(swap, 1 - value, value)


def gamma_inc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below the mean, a continued fraction above it."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    z = np.where(x > 0, x, 1.0)
    front = np.exp(a * np.log(z) - z - lgamma(a))
    term = total = 1 / a
    for k in range(1, 2000):
        term = term * z / (a + k)
        total = total + term
        if np.all((np.abs(term) < 1e-16 * np.abs(total)) | (z > a + 1)):
            break
    tiny = 1e-300
    b = z + 1 - a
    c, d = np.full_like(z, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
    f = d.copy()
    for k in range(1, 2000):
        step, b = -k * (k - a), b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + step / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        f = f * c * d
        if np.all((np.abs(c * d - 1) < 1e-15) | (z <= a + 1)):
            break
    with np.errstate(invalid="ignore", over="ignore"):
        value = np.where(z <= a + 1, front * total, 1 - front * f)
    return np.where(x > 0, np.clip(value, 0, 1), 0.0)


def t_logpdf(x, loc, scale, df) -> np.ndarray:
    z = (np.asarray(x, float) - loc) / scale
    return lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * np.log(df * np.pi) - np.log(scale) - (df + 1) / 2 * np.log1p(z * z / df)


def t_cdf(x, loc, scale, df) -> np.ndarray:
    z = (np.asarray(x, float) - loc) / scale
    df = np.asarray(df, float)
    # of the two forms of the same tail, the one whose argument keeps its digits
    far = z * z > df
    tail = 0.5 * np.where(
        far,
        beta_inc(df / 2, np.full_like(df, 0.5), df / (df + z * z)),
        1 - beta_inc(np.full_like(df, 0.5), df / 2, z * z / (df + z * z)),
    )
    return np.where(z > 0, 1 - tail, tail)


#: Weights, locations, scales and degrees of freedom; arrays of components, or of rows of components.
Mixture = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def mixture_cdf(x, m: Mixture) -> np.ndarray:
    """Distribution function at x, one value per row of components."""
    w, loc, scale, df = m
    return (w * t_cdf(np.asarray(x, float)[..., None], loc, scale, df)).sum(-1) / w.sum(-1)


def mixture_logpdf(x, m: Mixture) -> np.ndarray:
    """Log density by log-sum-exp; components of weight zero add nothing."""
    w, loc, scale, df = m
    with np.errstate(divide="ignore"):
        parts = np.log(w / w.sum(-1, keepdims=True)) + t_logpdf(np.asarray(x, float)[..., None], loc, scale, df)
    top = parts.max(-1)
    return top + np.log(np.exp(parts - top[..., None]).sum(-1))


def mixture_quantile(p, m: Mixture, steps: int = 60) -> np.ndarray:
    """By bisection of all rows at once, between bounds that hold the probabilities."""
    p = np.asarray(p, float)
    if np.any((p <= 0) | (p >= 1)):
        raise ValueError("a probability must lie between 0 and 1")
    w, loc, scale, _ = m
    reach = np.where(w > 0, scale, 0).max(-1)
    low = np.where(w > 0, loc, np.inf).min(-1) - reach
    high = np.where(w > 0, loc, -np.inf).max(-1) + reach
    step = reach.copy()
    while (short := mixture_cdf(low, m) > p).any():
        low, step = np.where(short, low - step, low), step * 2
    step = reach.copy()
    while (short := mixture_cdf(high, m) < p).any():
        high, step = np.where(short, high + step, high), step * 2
    for _ in range(steps):
        mid = (low + high) / 2
        if np.all((mid == low) | (mid == high)):
            break
        below = mixture_cdf(mid, m) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2
