"""Special functions and exact tests as vectorised pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# types, not DDL text: workers import this module without a session
_DOUBLE = T.DoubleType()
_FISHER = T.StructType([T.StructField(n, _DOUBLE) for n in ("p", "p_left", "p_right", "p_two")])

#: Factorials up to here are looked up; Stirling's series is exact to double beyond.
_TABLE = 20


def log_factorial(n) -> Column:
    """ln n! of a whole-number column, n >= 0, without Python."""
    n = F.col(n) if isinstance(n, str) else n
    x = n.cast("double")
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_TABLE)])
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < _TABLE, F.get(table, n.cast("int"))).otherwise(series)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


@F.pandas_udf(_DOUBLE)
def log_gamma(z: pd.Series) -> pd.Series:
    return pd.Series(_lgamma(z.to_numpy(float)), index=z.index)


@F.pandas_udf(_DOUBLE)
def erfc(x: pd.Series) -> pd.Series:
    return pd.Series(np.vectorize(math.erfc, otypes=[float])(x.to_numpy(float)), index=x.index)


def _gamma_p(s: float, z: float) -> float:
    """Regularised lower incomplete gamma: the series, or the continued fraction's rest."""
    if z <= 0:
        return 0.0
    if s <= 0:  # all of the mass lies at zero
        return 1.0
    scale = math.exp(-z + s * math.log(z) - math.lgamma(s))
    if z < s + 1:
        term = total = 1.0 / s
        k = s
        while term > total * 1e-15:
            k += 1
            term *= z / k
            total += term
        return scale * total
    return 1.0 - scale * _gamma_fraction(s, z)


def _gamma_fraction(s: float, z: float) -> float:
    tiny = 1e-300
    b = z + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


@F.pandas_udf(_DOUBLE)
def gamma_p(s: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([_gamma_p(a, b) for a, b in zip(s, z)], index=s.index)


@F.pandas_udf(_DOUBLE)
def gamma_q(s: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([1.0 - _gamma_p(a, b) for a, b in zip(s, z)], index=s.index)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or tiny)
            c = 1 + an / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(_DOUBLE)
def beta_inc(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([_beta(*v) for v in zip(a, b, x)], index=a.index)


def fisher(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float, float]:
    """(table probability, left, right, two-sided) of a 2x2 table; all 1 if degenerate."""
    row, col, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    lo, hi = max(0, row + col - n), min(row, col)
    if lo == hi:
        return 1.0, 1.0, 1.0, 1.0
    k = np.arange(lo, hi + 1)
    ln = lambda x: _lgamma(np.asarray(x, float) + 1)
    logp = ln(row) - ln(k) - ln(row - k) + ln(n - row) - ln(col - k) - ln(n - row - col + k) - ln(n) + ln(col) + ln(n - col)
    p = np.exp(logp)
    own = p[n11 - lo]
    left, right = p[: n11 - lo + 1].sum(), p[n11 - lo :].sum()
    two = min(1.0, p[p <= own * (1 + 1e-8)].sum())
    return float(own), float(min(1.0, left)), float(min(1.0, right)), float(two)


@F.pandas_udf(_FISHER)
def fisher_exact(n11: pd.Series, n12: pd.Series, n21: pd.Series, n22: pd.Series) -> pd.DataFrame:
    rows = [fisher(*map(int, v)) for v in zip(n11, n12, n21, n22)]
    return pd.DataFrame(rows, columns=["p", "p_left", "p_right", "p_two"])
