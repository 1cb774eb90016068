"""Distribution functions as numpy kernels, and as Arrow functions on columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Median of the chi-square distribution with one degree of freedom.
CHI2_MEDIAN = 0.4549364231195724

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_inverse = NormalDist().inv_cdf


def norm_sf(z: np.ndarray) -> np.ndarray:
    return _erfc(np.asarray(z, float) / math.sqrt(2)) / 2 if np.size(z) else np.asarray(z, float)


def _probit(p: float) -> float:
    if not p > 0:
        return -math.inf if p == 0 else math.nan
    if not p < 1:
        return math.inf if p == 1 else math.nan
    return _inverse(p)


def norm_ppf(p: np.ndarray) -> np.ndarray:
    return np.array([_probit(x) for x in np.ravel(p)], float).reshape(np.shape(p))


def gamma_q(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: a power series below a + 1, Lentz's continued fraction above."""
    x = np.asarray(x, float)
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 1.0
    lead = np.where(x > 0, np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - math.lgamma(a)), 0.0)
    low = (x > 0) & (x < a + 1)
    if low.any():
        v, term, total = x[low], np.full(low.sum(), 1 / a), np.full(low.sum(), 1 / a)
        for n in range(1, 500):
            term = term * v / (a + n)
            total += term
            if (term <= total * 1e-17).all():
                break
        out[low] = 1 - total * lead[low]
    high = x >= a + 1
    if high.any():
        v, tiny = x[high], 1e-300
        b = v + 1 - a
        c, d = np.full(v.shape, 1 / tiny), 1 / b
        h = d.copy()
        for n in range(1, 500):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = h * lead[high]
    return out


def chi2_sf(x: np.ndarray, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    if df == 1:
        return _erfc(np.sqrt(np.maximum(x, 0) / 2)) if x.size else x
    return gamma_q(df / 2, x / 2)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, v = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    ok = np.isfinite(v) & (v > 0) & (v < 1) & (p > 0) & (q > 0)
    out = np.where(v <= 0, 0.0, np.where(v >= 1, 1.0, np.nan))
    if ok.any():
        pp, qq, vv, tiny = p[ok], q[ok], v[ok], 1e-300
        c = np.ones(vv.shape)
        d = 1 - (pp + qq) * vv / (pp + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 1000):
            step = np.ones(vv.shape)
            for num in (m * (qq - m) * vv / ((pp + 2 * m - 1) * (pp + 2 * m)), -(pp + m) * (pp + qq + m) * vv / ((pp + 2 * m) * (pp + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = d * c
                h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        lead = np.exp(_lgamma(pp + qq) - _lgamma(pp) - _lgamma(qq) + pp * np.log(vv) + qq * np.log1p(-vv))
        out = out.copy()
        out[ok] = lead * h / pp
    return np.where(swap, 1 - out, out)


def f_sf(f: np.ndarray, d1: float, d2: np.ndarray) -> np.ndarray:
    """Upper tail of the F distribution."""
    f, d2 = np.broadcast_arrays(np.asarray(f, float), np.asarray(d2, float))
    return np.where(f >= 0, beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))), np.nan)


def _columnwise(fn) -> object:
    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(fn(x.to_numpy(float, na_value=np.nan)))

    return apply


def probit(p: Column) -> Column:
    """Quantile of the standard normal distribution; infinite at 0 and 1."""
    return _columnwise(norm_ppf)(p)


def two_sided(z: Column) -> Column:
    return _columnwise(lambda v: 2 * norm_sf(np.abs(v)))(z)


def pval_to_chi2(p: Column, two_sided_p: bool = True) -> Column:
    return F.pow(probit(p / 2 if two_sided_p else p), 2)


def pval_to_z(p: Column) -> Column:
    return -probit(p)


def z_to_pval(z: Column, two_sided_z: bool = True) -> Column:
    """Exact far into the tail, where one less the distribution function is 0."""
    return two_sided(z) if two_sided_z else _columnwise(norm_sf)(z)


def chi2_to_log_pval(x: Column, df: int) -> Column:
    return _columnwise(lambda v: np.log(chi2_sf(v, df)))(x)


def register(spark) -> None:
    """Make the functions callable from SQL text."""
    for name, fn in (("probit", norm_ppf), ("norm_sf", norm_sf), ("chi2_sf_1", lambda v: chi2_sf(v, 1))):
        spark.udf.register(name, _columnwise(fn))
