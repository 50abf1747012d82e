"""Descriptive and inferential statistics of vectors or lists.  Empty input raises ValueError where a mean is needed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.api import as_array, as_vector
from tessera.functions.distributions import Exponential, Normal, Poisson, StudentT
from tessera.functions.ieee import ln
from tessera.operators import reduce
from tessera.operators import stats as plans
from tessera.operators.matrix import Array
from tessera.operators.vector import Vector

__all__ = ["Exponential", "Normal", "Poisson", "StudentT", "anova_oneway", "correlation", "correlation_matrix", "covariance", "describe", "geometric_mean", "harmonic_mean", "iqr", "kurtosis", "linear_regression", "mad", "mean", "median", "mode", "skewness", "spearman_correlation", "std_dev", "sum", "t_test", "t_test_independent", "variance", "z_scores"]


def describe(data, compat: bool = False) -> dict[str, float]:
    """count, mean, variance, std, skewness (see reduce.moments for compat) and kurtosis in one pass."""
    found = as_vector(data).describe(compat)
    if not found["count"]:
        raise ValueError("no data")
    return found


def mean(data) -> float:
    return as_vector(data).mean()


def sum(data) -> float:
    return as_vector(data).sum()


def variance(data) -> float:
    """Sample variance; 0 of one number."""
    return describe(data)["variance"]


def std_dev(data) -> float:
    return describe(data)["std"]


def skewness(data, compat: bool = False) -> float:
    return describe(data, compat)["skewness"]


def kurtosis(data) -> float:
    return describe(data)["kurtosis"]


def median(data) -> float:
    return as_vector(data).median()


def mode(data) -> float:
    return as_vector(data).mode()


def iqr(data) -> float:
    return as_vector(data).iqr()


def mad(data) -> float:
    return as_vector(data).mad()


def geometric_mean(data) -> float:
    return as_vector(data)._one(F.exp(F.avg(ln(F.col("x")))))


def harmonic_mean(data) -> float:
    return as_vector(data)._one(1 / F.avg(1 / F.col("x")))


def z_scores(data) -> Vector:
    return as_vector(data).standardize()


def _pairs(x, y, least: int = 2) -> DataFrame:
    x, y = as_vector(x), as_vector(y)
    if len(x) != len(y) or len(x) < least:
        raise ValueError(f"two vectors of one length, {least} or more, are needed")
    return x._zip(y)


def correlation(x, y) -> float:
    return _pairs(x, y).agg(plans.correlation(F.col("x"), F.col("y")).alias("r")).first().r


def covariance(x, y) -> float:
    return _pairs(x, y).agg(plans.covariance(F.col("x"), F.col("y")).alias("r")).first().r


def correlation_matrix(a) -> Array:
    """Rows are variables."""
    return as_array(a).correlation_matrix()


def spearman_correlation(x, y) -> float:
    return plans.spearman(_pairs(x, y), "x", "y").first().rho


def linear_regression(x, y) -> dict[str, float]:
    """slope, intercept and r_squared of y on x."""
    return _pairs(x, y).agg(*[c.alias(k) for k, c in plans.linear_regression(F.col("x"), F.col("y")).items()]).first().asDict()


def _grouped(groups) -> DataFrame:
    out = None
    for k, g in enumerate(groups):
        part = as_vector(g).df.select(F.lit(k).alias("g"), "x")
        out = part if out is None else out.unionByName(part)
    return out


def t_test_independent(a, b) -> tuple[float, float, float]:
    """(t, degrees of freedom, p) without equal variances."""
    r = plans.welch(_grouped([a, b]), "g", 0, 1, "x").first()
    return r.t, r.df, r.p


t_test = t_test_independent


def anova_oneway(groups) -> tuple[float, float, float]:
    """(F, degrees of freedom between, within); empty groups are skipped."""
    rows = _grouped(groups) if groups else None
    if rows is None or rows.agg(F.count_distinct("g").alias("n")).first().n < 2:
        raise ValueError("two groups with data are needed")
    r = plans.anova(rows, "g", "x").first()
    return r.f, r.df_between, r.df_within


def moments_by(df: DataFrame, group: str, x: str) -> DataFrame:
    """describe() of every group of a table, in one aggregate."""
    return df.groupBy(group).agg(*[c.alias(k) for k, c in reduce.moments(F.col(x)).items()])
