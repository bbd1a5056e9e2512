"""Tail probabilities for rows that are already aggregated (one row per class or stratum).

These are Arrow-batched helpers on a handful of numbers per row. They never see raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_CHUNK = 200_000


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _tail_mass(k: int, step: int, a_total: int, b_total: int, drawn: int) -> float:
    """Sum of hypergeometric terms from ``k`` outwards, relative to the term at ``k``."""
    low, high = max(0, drawn - b_total), min(drawn, a_total)
    total, term, at = 1.0, 1.0, k
    while (at < high) if step > 0 else (at > low):
        stop = min(high, at + _CHUNK) if step > 0 else max(low, at - _CHUNK)
        x = np.arange(at, stop, step, dtype=np.float64)
        if step > 0:
            ratio = (a_total - x) * (drawn - x) / ((x + 1) * (b_total - drawn + x + 1))
        else:
            ratio = x * (b_total - drawn + x) / ((a_total - x + 1) * (drawn - x + 1))
        terms = term * np.cumprod(ratio)
        total += float(terms.sum())
        term, at = float(terms[-1]), stop
        if term < total * 1e-18:
            break
    return total


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table: all tables no more likely than the one observed.

    The terms are unimodal, so the tables to add are two outer tails; the far one starts where a
    bisection finds the first term at or below the observed probability.
    """
    a_total, b_total, drawn = a + b, c + d, a + c
    if min(a, b, c, d) < 0 or a_total == 0 or b_total == 0 or drawn in (0, a_total + b_total):
        return 1.0 if min(a, b, c, d) >= 0 else float("nan")
    low, high = max(0, drawn - b_total), min(drawn, a_total)
    base = _log_choose(a_total + b_total, drawn)

    def log_p(k: int) -> float:
        return _log_choose(a_total, k) + _log_choose(b_total, drawn - k) - base

    observed = log_p(a)
    limit = observed + 1e-7
    mode = min(high, max(low, int((drawn + 1) * (a_total + 1) / (a_total + b_total + 2))))
    if log_p(mode) <= limit:
        return 1.0
    outward = -1 if a < mode else 1
    p = math.exp(observed) * _tail_mass(a, outward, a_total, b_total, drawn)
    edge = high if outward < 0 else low
    if log_p(edge) <= limit:
        inside, outside = mode, edge
        while abs(outside - inside) > 1:
            mid = (inside + outside) // 2
            if log_p(mid) <= limit:
                outside = mid
            else:
                inside = mid
        p += math.exp(log_p(outside)) * _tail_mass(outside, -outward, a_total, b_total, drawn)
    return min(1.0, p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: float) -> float:
    """Two-sided p of a correlation from Student's t with n - 2 degrees of freedom."""
    df = n - 2.0
    if not (df > 0) or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, 1.0 - r * r)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*(int(v) for v in row)) for row in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) else correlation_p_value(float(x), float(m)) for x, m in zip(r, n)],
        dtype="float64",
    )
