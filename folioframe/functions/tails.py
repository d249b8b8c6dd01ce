"""Tail probabilities that Spark lacks, for small result tables."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|): the regularised incomplete beta function at df / (df + t^2)."""
    if df <= 0 or math.isnan(t):
        return math.nan
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(x, a, b) / a
    return 1 - front * _fraction(1 - x, b, a) / b


def _fraction(x: float, a: float, b: float, terms: int = 300) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, terms):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or tiny)
            c = (1 + up / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out
