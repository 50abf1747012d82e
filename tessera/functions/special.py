"""Functions that Spark lacks, as Arrow-batched UDFs."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _safe(f):
    def call(x: float) -> float:
        try:
            return f(x)
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf

    return call


def digamma_value(x: float) -> float:
    """psi(x) by recurrence to x >= 6 and the asymptotic series; poles are NaN."""
    if x <= 0:
        return math.nan if x == math.floor(x) else digamma_value(1 - x) - math.pi / math.tan(math.pi * x)
    shift = 0.0
    while x < 6:
        shift -= 1 / x
        x += 1
    t = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - t * (1 / 12 - t * (1 / 120 - t * (1 / 252 - t / 240)))


def _udf(f):
    vector = np.vectorize(_safe(f), otypes=[float])

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(vector(x.to_numpy(float)) if len(x) else x.astype(float))

    return apply


def gamma(x):
    return _udf(math.gamma)(x)


def ln_gamma(x):
    return _udf(math.lgamma)(x)


def erf(x):
    return _udf(math.erf)(x)


def digamma(x):
    return _udf(digamma_value)(x)


def betainc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, for all of x at once."""
    out = np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, x))
    inside = (x > 0) & (x < 1)
    late = inside & (x > (a + 1) / (a + b + 2))
    if late.any():
        out[late] = 1 - betainc(b, a, 1 - x[late])
    if (early := inside & ~late).any():
        out[early] = _fraction(a, b, x[early])
    return out


def _fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    whole = lambda y: np.where(y == 0, 1e-300, y)
    c, d = np.ones_like(x), 1 / whole(1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / whole(1 + top * d)
            c = whole(1 + top / c)
            total = total * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return front * total / a
