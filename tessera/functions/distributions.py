"""Distributions as parameter objects; pdf, cdf and ppf take a float or a column, sample gives a DataFrame."""

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.special import betainc


def _on(f, x):
    """f of a float here, of a column in Arrow batches there."""
    return _on_arrays(np.vectorize(f, otypes=[float]), x) if isinstance(x, Column) else f(x)


def _on_arrays(f, x):
    """As _on, for f of an array; a batch's equal values are worked out once."""
    if not isinstance(x, Column):
        return float(f(np.array([x], float))[0])

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        values, at = np.unique(s.to_numpy(float), return_inverse=True)
        return pd.Series(f(values)[at] if len(s) else s.astype(float))

    return apply(x)


def _exp(x):
    return F.exp(x) if isinstance(x, Column) else math.exp(x)


def _bisect(cdf, p: np.ndarray, lo: float, hi: float) -> np.ndarray:
    if not ((p >= 0) & (p <= 1)).all():
        raise ValueError("p outside [0, 1]")
    out, some = np.where(p == 0, -math.inf, math.inf), (p > 0) & (p < 1)
    q = p[some]
    lo, hi = np.full(len(q), float(lo)), np.full(len(q), float(hi))
    while (far := cdf(lo) > q).any():
        lo[far] *= 2
    while (far := cdf(hi) < q).any():
        hi[far] *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        low = cdf(mid) < q
        done = np.where(low, lo, hi) == mid
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        if done.all():
            break
    out[some] = (lo + hi) / 2
    return out


class _Sampled:
    def sample(self, spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
        """(idx, x): n draws by inversion (or a sum for normals), seeded where a seed is given."""
        u = F.rand(seed) if seed is not None else F.rand()
        return spark.range(n).select(F.col("id").alias("idx"), self._draw(u, seed).alias("x"))

    def _draw(self, u: Column, seed):
        return self.ppf(u)


@dataclass(frozen=True)
class Normal(_Sampled):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        if not self.sigma > 0:
            raise ValueError("sigma must be positive")

    def pdf(self, x):
        z = (x - self.mu) / self.sigma
        return _exp(-0.5 * z * z) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf(self, x):
        mu, s = self.mu, self.sigma * math.sqrt(2)
        return _on(lambda v: 0.5 * math.erfc(-(v - mu) / s), x)

    def ppf(self, p):
        d = NormalDist(self.mu, self.sigma)
        return _on(lambda v: -math.inf if v == 0 else math.inf if v == 1 else d.inv_cdf(v), p)

    def mean(self) -> float:
        return self.mu

    def _draw(self, u, seed):
        return self.mu + self.sigma * (F.randn(seed) if seed is not None else F.randn())


@dataclass(frozen=True)
class StudentT(_Sampled):
    location: float = 0.0
    scale: float = 1.0
    freedom: float = 1.0

    def __post_init__(self):
        if not (self.scale > 0 and self.freedom > 0):
            raise ValueError("scale and freedom must be positive")

    def pdf(self, x):
        v = self.freedom
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / (math.sqrt(v * math.pi) * self.scale)
        z = (x - self.location) / self.scale
        base = 1 + z * z / v
        return c * (F.pow(base, F.lit(-(v + 1) / 2)) if isinstance(x, Column) else base ** (-(v + 1) / 2))

    def _cdf(self, x: np.ndarray) -> np.ndarray:
        z, v = (x - self.location) / self.scale, self.freedom
        with np.errstate(over="ignore"):
            tail = 0.5 * betainc(v / 2, 0.5, v / (v + z * z))
        return np.where(z < 0, tail, 1 - tail)

    def cdf(self, x):
        return _on_arrays(self._cdf, x)

    def ppf(self, p):
        return _on_arrays(lambda q: _bisect(self._cdf, q, -1 - abs(self.location), 1 + abs(self.location)), p)


@dataclass(frozen=True)
class Poisson(_Sampled):
    rate: float = 1.0

    def __post_init__(self):
        if not self.rate > 0:
            raise ValueError("rate must be positive")

    def pmf(self, k):
        return _on(lambda v: 0.0 if v < 0 or v != math.floor(v) else math.exp(v * math.log(self.rate) - self.rate - math.lgamma(v + 1)), k)

    def _cdf(self, k: float) -> float:
        total, term = 0.0, math.exp(-self.rate)
        for i in range(int(math.floor(k)) + 1 if k >= 0 else 0):
            total += term
            term *= self.rate / (i + 1)
        return min(total, 1.0)

    def cdf(self, k):
        return _on(self._cdf, k)

    def _draw(self, u, seed):
        def invert(q: float) -> float:
            k, term = 0, math.exp(-self.rate)
            total = term
            while total < q and k < self.rate + 50 * math.sqrt(self.rate) + 100:
                k += 1
                term *= self.rate / k
                total += term
            return float(k)

        return _on(invert, u)


@dataclass(frozen=True)
class Exponential(_Sampled):
    rate: float = 1.0

    def __post_init__(self):
        if not self.rate > 0:
            raise ValueError("rate must be positive")

    def pdf(self, x):
        p = self.rate * _exp(-self.rate * x)
        return F.when(x < 0, 0.0).otherwise(p) if isinstance(x, Column) else (0.0 if x < 0 else p)

    def cdf(self, x):
        p = 1 - _exp(-self.rate * x)
        return F.when(x < 0, 0.0).otherwise(p) if isinstance(x, Column) else (0.0 if x < 0 else p)

    def ppf(self, p):
        return -F.log1p(-p) / self.rate if isinstance(p, Column) else (math.inf if p == 1 else -math.log1p(-p) / self.rate)
