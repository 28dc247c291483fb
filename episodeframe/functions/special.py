"""Special functions on the driver, from the standard library and numpy only."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def normal_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def normal_cdf(x: float) -> float:
    return _N.cdf(x)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def beta_ppf(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if betainc(a, b, mid) < q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-16:
            break
    return (lo + hi) / 2


def t_sf(t: float, dof: float) -> float:
    """P(T > t) of Student's distribution."""
    tail = 0.5 * betainc(dof / 2, 0.5, dof / (dof + t * t))
    return tail if t >= 0 else 1 - tail


def ks_pvalue(d: float, n: int, m: int, exact_most: int = 10_000) -> float:
    """Two-sided two-sample p-value: lattice paths for small samples, else the limit law."""
    if n == 0 or m == 0:
        return math.nan
    if max(n, m) <= exact_most and n * m <= 4_000_000:
        # Share of monotone paths (0,0)->(n,m) that reach |i/n - j/m| >= d.
        g = math.gcd(n, m)
        least = round(d * n * m / g)
        inside = np.zeros(m + 1)
        j = np.arange(m + 1)
        for i in range(n + 1):
            ok = np.abs(i * (m // g) - j * (n // g)) < least
            row = np.empty(m + 1)
            carry = 0.0
            for k in range(m + 1):
                up = inside[k] if i else 0.0
                value = (1.0 if i == 0 and k == 0 else (up * i / (i + k) if i else 0.0) + (carry * k / (i + k) if k else 0.0)) if ok[k] else 0.0
                row[k] = carry = value
            inside = row
        return float(min(1.0, max(0.0, 1.0 - inside[m])))
    x = d * math.sqrt(n * m / (n + m))
    if x <= 0:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


@lru_cache(maxsize=64)
def _mwu_counts(n: int, m: int) -> tuple[int, ...]:
    """Orders of n and m different values by their U: a Gaussian binomial's coefficients."""
    poly = [1]
    for i in range(1, n + 1):
        # times (1 - q^(m+i)) / (1 - q^i)
        up = poly + [0] * (m + i)
        for k in range(len(poly)):
            up[k + m + i] -= poly[k]
        for k in range(i, len(up)):
            up[k] += up[k - i]
        poly = up[: i * m + 1]
    return tuple(poly)


def mannwhitney_pvalue(u: float, n: int, m: int, tie_term: float) -> float:
    """Two-sided; exact where a sample has at most 8 values and none is tied.

    ``tie_term`` is the sum of t**3 - t over groups of t equal values.
    """
    if n == 0 or m == 0:
        return math.nan
    big = max(u, n * m - u)
    if min(n, m) <= 8 and tie_term == 0:
        counts = _mwu_counts(min(n, m), max(n, m))
        return min(1.0, 2 * sum(counts[math.ceil(big) :]) / sum(counts))
    size = n + m
    sd = math.sqrt(n * m / 12 * (size + 1 - tie_term / (size * (size - 1))))
    if sd == 0:
        return 1.0
    return min(1.0, 2 * (1 - normal_cdf((big - n * m / 2 - 0.5) / sd)))


def binomial_interval(k: int, n: int, ci: float = 0.95, method: str = "clopper-pearson") -> tuple[float, float]:
    if n <= 0:
        return math.nan, math.nan
    alpha = 1 - ci
    if method == "clopper-pearson":
        lo = beta_ppf(alpha / 2, k, n - k + 1) if k > 0 else 0.0
        hi = beta_ppf(1 - alpha / 2, k + 1, n - k) if k < n else 1.0
        return lo, hi
    if method != "wilson":
        raise ValueError(f"unknown method {method!r}")
    z, p = normal_ppf(1 - alpha / 2), k / n
    scale = 1 + z * z / n
    centre, margin = (p + z * z / (2 * n)) / scale, z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / scale
    return max(0.0, centre - margin), min(1.0, centre + margin)
