"""Ratios, correlations and p-values as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % point of the normal distribution.
Z_95 = 1.96


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, null where the denominator is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def corr_agg(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    kept_x, kept_y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(kept_x) * F.stddev_pop(kept_y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(kept_x, kept_y), spread))


def corrected_skew(values: Column) -> Column:
    """Sample skewness with the small-sample correction; null below three values."""
    n = F.count(values).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, factor * F.when(F.stddev_pop(values) > 0, F.skewness(values)).otherwise(F.lit(0.0)))


def corrected_kurtosis(values: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction; null below four values."""
    n = F.count(values).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    inner = (n + 1) * F.kurtosis(values) + 6
    return F.when(n >= 4, F.when(F.stddev_pop(values) > 0, factor * inner).otherwise(F.lit(0.0)))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value. Meant for summary rows: one per test, not per record."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))

    return tail(z)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300

    def steps():
        m = 0
        while True:
            if m > 0:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            m += 1

    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    value = d
    terms = steps()
    next(terms)
    for _, step in zip(range(500), terms):
        d = 1.0 / ((1.0 + step * d) or tiny)
        c = (1.0 + step / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def student_t_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    if not (np.isfinite(t) and df > 0):
        return math.nan
    if df >= 1e6 and t**4 < df / 1000:
        # The fraction below loses its digits as the sample grows; the normal tail gains them.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        t = abs(t)
        once, twice = (t**3 + t) / 2, (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / 48
        return math.erfc(t / math.sqrt(2)) + density * (once / df + twice / df**2)
    # Both parts of the whole by themselves, as neither can be had from the other where it is small.
    x, rest = df / (df + t * t), t * t / (df + t * t)
    a, b = df / 2.0, 0.5
    if rest <= 0.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(_log_gamma_step(a) - math.lgamma(b) - a * math.log1p(t * t / df) + b * math.log(rest))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def _log_gamma_step(a: float) -> float:
    """``lgamma(a + 1/2) - lgamma(a)``; for large ``a`` from the series, as the difference loses its digits."""
    if a < 1e4:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1.0 / (8.0 * a) + 1.0 / (192.0 * a**3)


def student_t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student p-value. Meant for summary rows: one per test, not per record."""

    @F.pandas_udf("double")
    def tail(values: pd.Series, freedom: pd.Series) -> pd.Series:
        out = [student_t_tail(v, f) if v == v and f == f else math.nan for v, f in zip(values, freedom)]
        return pd.Series(out, index=values.index).astype("float64").where(lambda s: s.notna(), None)

    return tail(t, df)


def correlation_p(r: Column, n: Column) -> Column:
    """p-value of a correlation by the t statistic on ``n - 2`` degrees of freedom."""
    freedom = n.cast("double") - 2
    t = r * F.sqrt(F.try_divide(freedom, F.greatest(1 - r * r, F.lit(1e-300))))
    return student_t_two_sided_p(t, freedom)
