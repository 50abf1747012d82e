"""Reductions of a column: aggregate expressions with defined results for empty input and NaN."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.operators import ordered


def _or_nan(c) -> Column:
    return F.coalesce(c, ieee.nan())


def total(x) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def prod(x) -> Column:
    return F.coalesce(F.product(x), F.lit(1.0))


def mean(x) -> Column:
    return _or_nan(F.avg(x))


def least(x) -> Column:
    """The minimum of what is not NaN."""
    return _or_nan(F.min(F.when(~F.isnan(x), x)))


def most(x) -> Column:
    return _or_nan(F.max(F.when(~F.isnan(x), x)))


def argmin(x, idx) -> Column:
    """First index of the minimum; -1 for no rows."""
    return F.coalesce(F.min_by(idx, F.struct(x, idx)), F.lit(-1).cast("long"))


def argmax(x, idx) -> Column:
    """Last index of the maximum; -1 for no rows."""
    return F.coalesce(F.max_by(idx, F.struct(x, idx)), F.lit(-1).cast("long"))


def variance(x) -> Column:
    return _or_nan(F.var_samp(x))


def pop_variance(x) -> Column:
    return _or_nan(F.var_pop(x))


def std_dev(x) -> Column:
    return _or_nan(F.stddev_samp(x))


def pop_std_dev(x) -> Column:
    return _or_nan(F.stddev_pop(x))


def median(x) -> Column:
    """For groups of a bounded number of distinct values: one buffer holds them.  See ordered.quantiles for whole columns."""
    return _or_nan(F.median(x))


def percentile(x, q: float) -> Column:
    if not 0 <= q <= 100:
        raise ValueError("q outside [0, 100]")
    return _or_nan(F.percentile(x, F.lit(q / 100)))


def norm(x) -> Column:
    return F.sqrt(total(x * x))


def norm_l1(x) -> Column:
    return total(F.abs(x))


def norm_inf(x) -> Column:
    return F.coalesce(F.max(F.abs(x)), F.lit(0.0))


def norm_lp(x, p: float) -> Column:
    if p <= 0:
        raise ValueError("p must be positive")
    return F.pow(total(F.pow(F.abs(x), F.lit(p))), F.lit(1 / p))


def dot(x, y) -> Column:
    return total(x * y)


def any_(x) -> Column:
    return F.coalesce(F.bool_or(F.isnan(x) | (x != 0)), F.lit(False))


def all_(x) -> Column:
    return F.coalesce(F.bool_and(F.isnan(x) | (x != 0)), F.lit(True))


def moments(x, compat: bool = False) -> dict[str, Column]:
    """count, mean, variance, std, skewness and kurtosis of one pass.  With compat, skewness is sqrt(n) times the sum of
    cubed distances over the cubed sample deviation: the textbook value times (n - 1)^1.5."""
    n, m = F.count(x), F.avg(x)
    var = F.coalesce(F.var_samp(x), F.lit(0.0))
    return {"count": n, "mean": m, "variance": var, "std": F.sqrt(var), "skewness": F.coalesce(F.skewness(x) * (F.pow(n - 1, F.lit(1.5)) if compat else 1.0), F.lit(0.0)), "kurtosis": F.coalesce(F.kurtosis(x), F.lit(0.0))}


def mode(df: DataFrame, x: str, idx: str) -> DataFrame:
    """One row `mode`: the value of the highest count, that seen first on ties."""
    return df.groupBy(x).agg(F.count("*").alias("n"), F.min(idx).alias("first")).agg(F.max_by(x, F.struct("n", -F.col("first"))).alias("mode"))


def mad(df: DataFrame, x: str) -> DataFrame:
    """One row `mad`: the median distance from the median."""
    centre = ordered.quantiles(df, x, {"_c": 0.5})
    apart = df.crossJoin(F.broadcast(centre)).select(F.abs(F.col(x) - F.col("_c")).alias("_d"))
    return ordered.quantiles(apart, "_d", {"mad": 0.5}).select(_or_nan(F.col("mad")).alias("mad"))


def unique(df: DataFrame, x: str, idx: str) -> DataFrame:
    """(first, x): distinct values with the index where each is first seen."""
    return df.groupBy(x).agg(F.min(idx).alias("first"))
