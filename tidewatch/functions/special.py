"""Tail probabilities that Spark SQL lacks, for small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction (Lentz) above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_tail(x: float, degrees: float) -> float:
    return _gamma_tail(degrees / 2, x / 2)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_tail_two_sided(t: float, degrees: float) -> float:
    return _beta(degrees / 2, 0.5, degrees / (degrees + t * t))


def t_quantile(p: float, degrees: float) -> float:
    """Upper quantile: P(T <= q) = p for p >= 0.5."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_tail_two_sided(mid, degrees) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _normal_sf(z: pd.Series) -> pd.Series:
    return z.map(normal_tail, na_action="ignore").astype("float64")


def _chi_square_sf(x: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi_square_tail(a, b) for a, b in zip(x, degrees, strict=True)], dtype="float64")


def _t_sf(t: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_tail_two_sided(a, b) for a, b in zip(t, degrees, strict=True)], dtype="float64")


def normal_sf(z: Column) -> Column:
    return pandas_udf(_normal_sf, "double")(z)


def chi_square_sf(x: Column, degrees: Column) -> Column:
    return pandas_udf(_chi_square_sf, "double")(x, degrees)


def t_sf_two_sided(t: Column, degrees: Column) -> Column:
    return pandas_udf(_t_sf, "double")(t, degrees)


def _t_quantile(p: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_quantile(a, b) for a, b in zip(p, degrees, strict=True)], dtype="float64")


def t_upper_quantile(p: Column, degrees: Column) -> Column:
    return pandas_udf(_t_quantile, "double")(p, degrees)
