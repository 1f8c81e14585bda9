"""Distribution functions on numpy arrays, used on small aggregated rows only."""

from __future__ import annotations

import functools
import math

import numpy as np

_erf = np.frompyfunc(math.erf, 1, 1)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    z = np.asarray(z, dtype=float)
    shift = np.zeros_like(z)
    for _ in range(10):
        small = z < 10
        shift = shift + np.where(small, np.log(np.where(small, z, 1.0)), 0.0)
        z = np.where(small, z + 1, z)
    tail = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - shift


def _beta_fraction(x, a, b, steps: int = 400):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    return h


def beta_inc(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    ok = np.isfinite(x) & (a > 0) & (b > 0)
    xs = np.where(ok, np.clip(x, 0, 1), 0.5)
    a, b = np.where(ok, a, 1.0), np.where(ok, b, 1.0)
    swap = xs > (a + 1) / (a + b + 2)
    u = np.where(swap, 1 - xs, xs)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore"):
        log_front = (p * np.log(u) + q * np.log1p(-u)
                     - (log_gamma(p) + log_gamma(q) - log_gamma(p + q)))
    part = np.exp(log_front) * _beta_fraction(u, p, q) / p
    return np.where(ok, np.where(swap, 1 - part, part), np.nan)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_inc(df / (df + t * t), df / 2, 0.5)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_inc(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def _bisect(fn, lo, hi, rounds: int = 100):
    """Root of an increasing vector function between arrays lo and hi."""
    for _ in range(rounds):
        mid = (lo + hi) / 2
        above = fn(mid) > 0
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return (lo + hi) / 2


def t_quantile_two_sided(alpha, df) -> np.ndarray:
    """Positive t with two-sided tail mass alpha."""
    alpha, df = np.broadcast_arrays(np.asarray(alpha, float), np.asarray(df, float))
    # Widen until the tail is small enough; an invalid df or alpha stops at once.
    high = np.full(df.shape, 16.0)
    while True:
        short = (df > 0) & (alpha > 0) & (t_two_sided(high, df) > alpha) & (high < 1e300)
        if not short.any():
            break
        high = np.where(short, high * 16, high)
    root = _bisect(lambda t: alpha - t_two_sided(t, df), np.zeros(df.shape), high, rounds=200)
    return np.where(df > 0, root, np.nan)


def normal_cdf(z) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z, dtype=float) / math.sqrt(2)).astype(float))


def normal_quantile(p) -> np.ndarray:
    p = np.asarray(p, dtype=float)
    root = _bisect(lambda z: normal_cdf(z) - p, np.full(p.shape, -40.0),
                   np.full(p.shape, 40.0), rounds=64)
    return np.where((p > 0) & (p < 1), root, np.nan)


@functools.lru_cache(maxsize=4096)
def studentized_range_upper(q: float, k: int, df: float) -> float:
    """P(Q > q) for k means and df error degrees of freedom, by quadrature."""
    if not (math.isfinite(q) and k >= 2 and df > 0):
        return math.nan
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = 8.5 * z, 8.5 * wz                       # normal range [-8.5, 8.5]
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = normal_cdf(z)
    # Scale s = sqrt(chi2/df): its density is concentrated near 1.
    spread = 9 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - spread), 1 + spread + 9 / df
    s, ws = np.polynomial.legendre.leggauss(96)
    s, ws = lo + (s + 1) * (hi - lo) / 2, ws * (hi - lo) / 2
    log_density = (math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
                   + (df - 1) * np.log(s) - df * s * s / 2)
    gap = upper[None, :] - normal_cdf(z[None, :] - (q * s)[:, None])
    inner = k * ((phi * wz)[None, :] * np.clip(gap, 0, 1) ** (k - 1)).sum(axis=1)
    return float(min(1.0, max(0.0, 1 - (ws * np.exp(log_density) * inner).sum())))


@functools.lru_cache(maxsize=256)
def studentized_range_quantile(alpha: float, k: int, df: float) -> float:
    """q with P(Q > q) = alpha."""
    lo, hi = 0.0, 16.0
    while studentized_range_upper(hi, k, df) > alpha and hi < 1e12:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        if studentized_range_upper(mid, k, df) > alpha:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
