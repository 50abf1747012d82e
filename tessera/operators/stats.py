"""Inferential statistics and regression as aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordered


def _guarded(num, den) -> Column:
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(0.0)


def correlation(x, y) -> Column:
    """Pearson's coefficient; 0 where either side is constant."""
    spread = F.var_pop(x) * F.var_pop(y)
    return _guarded(F.covar_pop(x, y), F.sqrt(spread))


def covariance(x, y) -> Column:
    return F.covar_samp(x, y)


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """(a, b, r) for all pairs of columns: one aggregate over one scan."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[(F.lit(1.0) if a == b else correlation(F.col(a), F.col(b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def linear_regression(x, y) -> dict[str, Column]:
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r_squared": F.regr_r2(y, x)}


def average_ranks(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with 0-based ranks of x, ties sharing their mean rank.  Ranks come from running
    counts of the distinct values, in two levels."""
    counts = ordered.with_index(df.groupBy(F.col(x).alias("_v")).count(), "_v", name="_i")
    ranks = ordered.cumsum(counts, "count", "_upto", "_i").select("_v", (F.col("_upto") - F.col("count") + (F.col("count") - 1) / 2).alias(out))
    return df.join(ranks, F.col(x) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row `rho`: Pearson's coefficient of average ranks."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(correlation(F.col("_rx"), F.col("_ry")).alias("rho"))


def welch(df: DataFrame, group: str, a, b, x: str) -> DataFrame:
    """One row t, df, p of two groups' means without equal variances; p is the closed form (df / (df + t^2))^(df / 2)."""
    of = lambda g: F.when(F.col(group) == g, F.col(x))
    m = df.agg(*[f(of(g)).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    t, free = (F.col("ma") - F.col("mb")) / F.sqrt(sa + sb), (sa + sb) * (sa + sb) / (sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1))
    out = m.select(t.alias("t"), free.alias("df"))
    return out.withColumn("p", F.pow(F.col("df") / (F.col("df") + F.col("t") * F.col("t")), F.col("df") / 2))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """One row f, df_between, df_within."""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).filter("n > 0")
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between, within = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    return s.select((((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / between) / (F.col("w") / within)).alias("f"), between.alias("df_between"), within.alias("df_within"))
