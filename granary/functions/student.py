"""Student's t distribution for aggregated rows (numpy; a few values per group)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(t: float, df: float) -> float | None:
    """Probability of a |t| at least this large; None where t or df is no number."""
    if t is None or df is None or not math.isfinite(t) or not df > 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def quantile(level: float, df: float) -> float | None:
    """The t that a two-sided interval of this level reaches."""
    if df is None or not df > 0:
        return None
    lo, hi = 0.0, 1.0
    while two_sided_p(hi, df) > 1 - level:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if two_sided_p(mid, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


def p_value(t: Column, df: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(t.cast("double"), df.cast("double"))


def t_quantile(level: float, df: Column) -> Column:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([quantile(level, x) for x in a], dtype="float64")

    return F.pandas_udf(run, "double")(df.cast("double"))
