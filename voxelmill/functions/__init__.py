"""Scalar functions of fitted distributions and seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi_pdf(x: Column, df: float, scale: float) -> Column:
    """Density of a chi distribution with location 0."""
    log_norm = (1 - df / 2) * math.log(2) - math.lgamma(df / 2) - math.log(scale)
    return F.when(x > 0, F.exp(F.lit(log_norm) + (df - 1) * F.log(x / scale) - (x / scale) ** 2 / 2)).otherwise(0.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return lead * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - lead * h


def chi_quantile(q: float, df: float, scale: float) -> float:
    """Quantile of a chi distribution with location 0, by bisection."""
    low, high = 0.0, 1.0
    while gamma_p(df / 2, high * high / 2) < q:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(df / 2, mid * mid / 2) < q else (low, mid)
    return scale * (low + high) / 2
