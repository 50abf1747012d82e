"""The registered queries of the numeric engine, each with the SQL that must give the same rows."""

from pyspark.sql import functions as F

from tessera.functions import distributions, ieee, nn, special
from tessera.operators import geometry, matrix, ordered, reduce, signal, stats, table
from tessera.operators.autograd import Node
from tessera.operators.scalar import Dual, Quaternion, rotated
from tessera.operators.vector import Vector
from tessera.plans import wrappers, wrappers_matrix  # noqa: F401
from tessera.plans.registry import QUERIES, SQL, integral, r  # noqa: F401
from tessera.plans.registry import query as _query
from tessera.plans.registry import table as _t
from tessera.streaming import moments

def _price():
    return F.col("l_extendedprice")


def _discount():
    return F.col("l_discount")


@_query("""
WITH f AS (SELECT l_quantity AS q, least(greatest(l_extendedprice, 1000), 60000) AS p, l_discount AS d, l_tax AS t FROM lineitem WHERE l_quantity > 2 AND l_extendedprice < 90000 AND l_discount >= 0),
s AS (SELECT *, p * (1 - d) AS net, p / q AS unit, CASE WHEN p > 40000 AND d > 0.05 THEN 'deal' WHEN p > 40000 THEN 'premium' WHEN d > 0.05 THEN 'bargain' ELSE 'base' END AS segment FROM f)
SELECT segment, count(*) AS n, round(avg(net), 3) AS mean_net, round(stddev_samp(unit), 4) AS sd_unit, round(corr(q, net), 6) AS r_q_net, round(regr_slope(net, q), 4) AS slope, round(regr_intercept(net, q), 3) AS intercept, round(regr_r2(net, q), 6) AS r2 FROM s GROUP BY segment""")
def segment_pipeline(spark, sf_dir):
    """The flagship: clean, derive features, segment, describe, correlate and regress in one pass over lineitem."""
    kept = table.multi_filter_where(_t(spark, sf_dir, "lineitem"), [F.col("l_quantity").alias("q"), ieee.clamp(_price(), 1000, 60000).alias("p"), _discount().alias("d")], [("l_quantity", "gt", 2.0), ("l_extendedprice", "lt", 90000.0), ("l_discount", "ge", 0.0)])
    full = kept.withColumn("net", F.col("p") * (1 - F.col("d"))).withColumn("unit", ieee.div(F.col("p"), F.col("q")))
    seg = table.segments(full, "segment", [("deal", [("p", "gt", 40000.0), ("d", "gt", 0.05)]), ("premium", [("p", "gt", 40000.0)]), ("bargain", [("d", "gt", 0.05)])], "base")
    fit = stats.linear_regression(F.col("q"), F.col("net"))
    return seg.groupBy("segment").agg(F.count("*").alias("n"), r(F.avg("net"), 3).alias("mean_net"), r(F.stddev_samp("unit"), 4).alias("sd_unit"), r(stats.correlation(F.col("q"), F.col("net"))).alias("r_q_net"), r(fit["slope"], 4).alias("slope"), r(fit["intercept"], 3).alias("intercept"), r(fit["r_squared"]).alias("r2"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_tax <> 0.04")
def filter_where_all(spark, sf_dir):
    return table.multi_filter_where(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [("l_quantity", "gt", 45.0), ("l_discount", "<=", 0.02), ("l_tax", "ne", 0.04)])


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 50 OR l_extendedprice < 1000 OR l_discount = 0.1")
def filter_where_any(spark, sf_dir):
    return table.multi_filter_where(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [("l_quantity", "ge", 50.0), ("l_extendedprice", "lt", 1000.0), ("l_discount", "eq", 0.1)], "any")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_tax > 0.05")
def filter_by_masks(spark, sf_dir):
    return table.filter_by_masks(_t(spark, sf_dir, "lineitem"), [F.col("l_quantity") > 40, F.when(F.col("l_tax") > 0.05, 1.0).otherwise(0.0)]).select("l_orderkey", "l_linenumber")


@_query("SELECT sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS gt, sum(CASE WHEN l_quantity < 10 THEN 1.0 ELSE 0.0 END) AS lt, sum(CASE WHEN l_quantity = 10 THEN 1.0 ELSE 0.0 END) AS eq, bool_or(l_discount <> 0) AS any_nonzero, bool_and(l_discount <> 0) AS all_nonzero FROM lineitem")
def masks_any_all(spark, sf_dir):
    q = F.col("l_quantity")
    m = lambda op, t: F.sum(F.when(ieee.compare(q, op, t), 1.0).otherwise(0.0))
    return _t(spark, sf_dir, "lineitem").agg(m("gt", 25.0).alias("gt"), m("lt", 10.0).alias("lt"), m("eq", 10.0).alias("eq"), reduce.any_(_discount()).alias("any_nonzero"), reduce.all_(_discount()).alias("all_nonzero"))


@_query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE l_quantity END, 2) AS v FROM lineitem")
def where_select(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(F.when(ieee.compare(F.col("l_quantity"), "gt", 25.0), _price()).otherwise(F.col("l_quantity")), 2).alias("v"))


_UNARY = {"sqrt": "sqrt(u)", "cbrt": "cbrt(u)", "sin": "sin(u)", "cos": "cos(u)", "tan": "tan(u)", "atan": "atan(u)", "sinh": "sinh(u)", "cosh": "cosh(u)", "tanh": "tanh(u)", "asinh": "asinh(u)", "exp": "exp(u)", "exp2": "pow(2, u)", "expm1": "exp(u) - 1", "log": "ln(u)", "log2": "log2(u)", "log10": "log10(u)", "log1p": "ln(1 + u)", "abs": "abs(u)", "ceil": "ceil(u)", "floor": "floor(u)", "round": "round(u)", "trunc": "trunc(u)", "fract": "u - trunc(u)", "signum": "CAST(sign(u) AS DOUBLE)", "recip": "1 / u", "sigmoid": "1 / (1 + exp(-u))"}


@_query("SELECT p_partkey, " + ", ".join(f"round({e} + 0.0, 6) AS f_{n}" for n, e in _UNARY.items()) + " FROM (SELECT p_partkey, p_retailprice / 500 AS u FROM part)")
def elementwise_math(spark, sf_dir):
    u = F.col("u")
    return _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 500).alias("u")).select("p_partkey", *[r(ieee.ELEMENTWISE[n](u)).alias(f"f_{n}") for n in _UNARY])


@_query("SELECT p_partkey, round(asin(u), 6) AS f_asin, round(acos(u), 6) AS f_acos, round(atanh(u), 6) AS f_atanh, round(atan2(u, 0.5), 6) AS f_atan2, round(sqrt(u * u + 9), 6) AS f_hypot, round(u + 0.25 * (2 - u), 6) AS f_lerp, round(pow(u, 1.5), 6) AS f_pow FROM (SELECT p_partkey, p_retailprice / 5000 AS u FROM part)")
def elementwise_two(spark, sf_dir):
    u = F.col("u")
    return _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 5000).alias("u")).select("p_partkey", r(F.asin(u)).alias("f_asin"), r(F.acos(u)).alias("f_acos"), r(F.atanh(u)).alias("f_atanh"), r(F.atan2(u, F.lit(0.5))).alias("f_atan2"), r(F.hypot(u, F.lit(3.0))).alias("f_hypot"), r(u + 0.25 * (2 - u)).alias("f_lerp"), r(F.pow(u, F.lit(1.5))).alias("f_pow"))


@_query("SELECT c_custkey, round(CASE WHEN d = 0 THEN -1 ELSE c_acctbal / d END, 6) AS quotient, CASE WHEN d = 0 THEN CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal < 0 THEN -1 ELSE 0 END ELSE 9 END AS infinite, round(CASE WHEN d = 0 THEN 0 ELSE floor(c_acctbal / d) END, 2) AS whole, d = 0 AS no_rest, round(CASE WHEN d = 0 THEN 0 ELSE c_acctbal % d END, 6) AS rest, CASE WHEN c_acctbal <= 0 THEN 0 ELSE round(ln(c_acctbal), 6) END AS safe_log FROM (SELECT *, CAST(c_nationkey % 5 AS DOUBLE) AS d FROM customer)")
def ieee_edges(spark, sf_dir):
    d, x = F.col("d"), F.col("c_acctbal")
    q, m, log = ieee.div(x, d), ieee.mod(x, d), ieee.ln(x)
    c = _t(spark, sf_dir, "customer").withColumn("d", (F.col("c_nationkey") % 5).cast("double"))
    side = F.when(ieee.isfinite(q), 9).when(F.isnan(q), 0).when(q > 0, 1).otherwise(-1)
    return c.select("c_custkey", r(F.when(ieee.isfinite(q), q).otherwise(-1.0)).alias("quotient"), side.alias("infinite"), r(F.when(ieee.isfinite(q), ieee.floordiv(x, d)).otherwise(0.0), 2).alias("whole"), F.isnan(m).alias("no_rest"), r(F.when(F.isnan(m), 0.0).otherwise(m)).alias("rest"), r(F.when(ieee.isfinite(log), log).otherwise(0.0)).alias("safe_log"))


@_query("SELECT c_custkey, round(least(greatest(c_acctbal, -100), 5000), 2) AS clamped, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sigmoid, round(c_acctbal + 0.5 * (100 - c_acctbal), 4) AS lerped FROM customer")
def clamp_lerp_sigmoid(spark, sf_dir):
    b = F.col("c_acctbal")
    return _t(spark, sf_dir, "customer").select("c_custkey", r(ieee.clamp(b, -100, 5000), 2).alias("clamped"), r(ieee.sigmoid(b / 1000)).alias("sigmoid"), r(b + 0.5 * (100 - b), 4).alias("lerped"))


@_query("SELECT p_partkey, p_size IN (2,3,5,7,11,13,17,19,23,29,31,37,41,43,47) AS prime, p_size % 1 = 0 AS whole FROM part")
def is_prime_integer(spark, sf_dir):
    s = F.col("p_size").cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", ieee.is_prime(s).alias("prime"), ieee.is_integer(s).alias("whole"))


@_query("SELECT count(*) AS count, round(avg(x), 4) AS mean, round(var_samp(x), 1) AS variance, round(stddev_samp(x), 4) AS std, round((avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*pow(avg(x), 3)) / pow(var_pop(x), 1.5), 4) AS skewness, round(kurtosis_pop(x), 4) AS kurtosis FROM (SELECT l_extendedprice / 1000 AS x FROM lineitem)")
def describe(spark, sf_dir):
    m = reduce.moments(_price() / 1000)
    return _t(spark, sf_dir, "lineitem").agg(*[(c if k == "count" else r(c, 1 if k == "variance" else 4)).alias(k) for k, c in m.items()])


@_query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_tax), 8) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(var_samp(l_tax), 8) AS var, round(var_pop(l_tax), 8) AS pvar, round(stddev_samp(l_tax), 8) AS sd, round(stddev_pop(l_tax), 8) AS psd FROM lineitem")
def reductions(spark, sf_dir):
    t = F.col("l_tax")
    return _t(spark, sf_dir, "lineitem").agg(r(reduce.total(F.col("l_quantity")), 2).alias("total"), r(reduce.mean(t), 8).alias("mean"), reduce.least(_price()).alias("least"), reduce.most(_price()).alias("most"), r(reduce.variance(t), 8).alias("var"), r(reduce.pop_variance(t), 8).alias("pvar"), r(reduce.std_dev(t), 8).alias("sd"), r(reduce.pop_std_dev(t), 8).alias("psd"))


@_query("SELECT 0.0::DOUBLE AS total, 1.0::DOUBLE AS prod, CAST(-1 AS BIGINT) AS argmin, true AS no_mean, true AS no_min, true AS all_of_none, false AS any_of_none")
def empty_reductions(spark, sf_dir):
    none, q = _t(spark, sf_dir, "lineitem").filter("l_quantity < -1"), F.col("l_quantity")
    return none.agg(reduce.total(q).alias("total"), reduce.prod(q).alias("prod"), reduce.argmin(q, F.col("l_orderkey")).alias("argmin"), F.isnan(reduce.mean(q)).alias("no_mean"), F.isnan(reduce.least(q)).alias("no_min"), reduce.all_(q).alias("all_of_none"), reduce.any_(q).alias("any_of_none"))


@_query("SELECT round(quantile_cont(o_totalprice, 0.05), 3) AS p5, round(quantile_cont(o_totalprice, 0.25), 3) AS p25, round(median(o_totalprice), 3) AS p50, round(quantile_cont(o_totalprice, 0.975), 3) AS p97, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 3) AS iqr FROM orders")
def percentiles(spark, sf_dir):
    found = ordered.quantiles(_t(spark, sf_dir, "orders"), "o_totalprice", {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97": 0.975})
    return found.select(*[r(c, 3).alias(c) for c in ("p5", "p25", "p50", "p97")], r(F.col("p75") - F.col("p25"), 3).alias("iqr"))


@_query("SELECT round(median(abs(o_totalprice - m)), 3) AS mad FROM orders, (SELECT median(o_totalprice) AS m FROM orders)")
def mad(spark, sf_dir):
    return reduce.mad(_t(spark, sf_dir, "orders"), "o_totalprice").select(r("mad", 3).alias("mad"))


@_query("SELECT l_quantity AS mode FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 1")
def mode_first(spark, sf_dir):
    return reduce.mode(_t(spark, sf_dir, "lineitem").withColumn("i", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_quantity", "i")


@_query("SELECT round(sqrt(sum(l_quantity * l_quantity)), 4) AS l2, round(sum(abs(l_quantity)), 2) AS l1, max(abs(l_quantity)) AS linf, round(pow(sum(pow(abs(l_quantity), 3)), 1.0 / 3), 4) AS l3, round(sum(l_quantity * l_tax), 3) AS dot, round(product(1 + l_tax / 1e6), 8) AS prod FROM lineitem")
def norms_dot_prod(spark, sf_dir):
    q = F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").agg(r(reduce.norm(q), 4).alias("l2"), r(reduce.norm_l1(q), 2).alias("l1"), reduce.norm_inf(q).alias("linf"), r(reduce.norm_lp(q, 3.0), 4).alias("l3"), r(reduce.dot(q, F.col("l_tax")), 3).alias("dot"), r(reduce.prod(1 + F.col("l_tax") / 1e6), 8).alias("prod"))


@_query("SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS argmin, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS argmax")
def argmin_argmax(spark, sf_dir):
    return _t(spark, sf_dir, "orders").agg(reduce.argmin(F.col("o_totalprice"), F.col("o_orderkey")).alias("argmin"), reduce.argmax(F.col("o_totalprice"), F.col("o_orderkey")).alias("argmax"))


def _events(spark, sf_dir):
    return ordered.with_index(_t(spark, sf_dir, "events").select("event_id", F.col("value").alias("x")), "event_id")


@_query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS cumsum FROM events")
def cumsum(spark, sf_dir):
    return ordered.cumsum(_events(spark, sf_dir), out="c").select("event_id", r("c", 4).alias("cumsum"))


@_query("SELECT event_id, round(product(1 + value / 1e9) OVER (ORDER BY event_id), 8) AS cumprod FROM events")
def cumprod(spark, sf_dir):
    return ordered.cumprod(_events(spark, sf_dir).withColumn("x", 1 + F.col("x") / 1e9), out="c").select("event_id", r("c", 8).alias("cumprod"))


@_query("SELECT idx, x FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, round(lead(value) OVER (ORDER BY event_id) - value, 6) AS x FROM events) WHERE x IS NOT NULL")
def diff(spark, sf_dir):
    return ordered.diff(_events(spark, sf_dir)).select("idx", r("x").alias("x"))


@_query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx, o_orderkey, o_totalprice FROM orders")
def sort_argsort(spark, sf_dir):
    return ordered.with_index(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("idx", "o_orderkey", "o_totalprice")


@_query("SELECT row_number() OVER (ORDER BY l_extendedprice) - 1 AS idx, l_extendedprice AS x FROM lineitem")
def row_index(spark, sf_dir):
    """Every row of lineitem, all its columns sorted and numbered."""
    return ordered.with_index(_t(spark, sf_dir, "lineitem"), "l_extendedprice").select("idx", F.col("l_extendedprice").alias("x"))


@_query("SELECT row_number() OVER (ORDER BY l_extendedprice) - 1 AS idx, l_extendedprice AS x FROM lineitem WHERE l_extendedprice > 20000 AND l_extendedprice < 80000")
def filter_sorted(spark, sf_dir):
    """A sorted vector, filtered twice and numbered anew."""
    return Vector.from_table(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_extendedprice").filter_gt(20000).filter_lt(80000).df


@_query("SELECT 'head' AS part, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7) UNION ALL SELECT 'tail', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7)")
def head_tail(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy("o_orderkey").limit(7).select(F.lit("head").alias("part"), "o_orderkey").unionByName(o.orderBy(F.desc("o_orderkey")).limit(7).select(F.lit("tail").alias("part"), "o_orderkey"))


@_query("SELECT l_quantity AS x, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_quantity")
def unique(spark, sf_dir):
    return reduce.unique(_t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i")), "x", "i")


@_query("SELECT chunk, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS chunk, value FROM events) GROUP BY chunk")
def chunks(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.floor(F.col("idx") / 100).alias("chunk")).agg(F.count("*").alias("n"), r(F.sum("x"), 4).alias("total"))


@_query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z, round(exp(c_acctbal / 1000 - t) / e, 9) AS p FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, max(c_acctbal / 1000) AS t FROM customer), (SELECT sum(exp(c_acctbal / 1000 - (SELECT max(c_acctbal / 1000) FROM customer))) AS e FROM customer)")
def standardize_softmax(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    one = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"), F.max(F.col("c_acctbal") / 1000).alias("t"))
    shifted = c.crossJoin(F.broadcast(one)).withColumn("e", F.exp(F.col("c_acctbal") / 1000 - F.col("t")))
    total = shifted.agg(F.sum("e").alias("total"))
    return shifted.crossJoin(F.broadcast(total)).select("c_custkey", r((F.col("c_acctbal") - F.col("m")) / F.col("s")).alias("z"), r(F.col("e") / F.col("total"), 9).alias("p"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + 0.0, 6) AS r FROM lineitem" for a in _COLS for b in _COLS if a != b) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in _COLS))
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(_t(spark, sf_dir, "lineitem"), _COLS).select("a", "b", r("r").alias("r"))


@_query("SELECT round(covar_samp(l_quantity, l_extendedprice), 1) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS r, 0.0::DOUBLE AS r_constant FROM lineitem")
def covariance(spark, sf_dir):
    q = F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").agg(r(stats.covariance(q, _price()), 1).alias("cov"), r(stats.correlation(q, _price())).alias("r"), stats.correlation(q, F.lit(1.0)).alias("r_constant"))


@_query("SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)")
def spearman(spark, sf_dir):
    return stats.spearman(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(r("rho").alias("rho"))


_WELCH = "(SELECT avg(x) FILTER (g = 'A') AS ma, avg(x) FILTER (g = 'R') AS mb, var_samp(x) FILTER (g = 'A') / count(*) FILTER (g = 'A') AS sa, var_samp(x) FILTER (g = 'R') / count(*) FILTER (g = 'R') AS sb, count(*) FILTER (g = 'A') AS na, count(*) FILTER (g = 'R') AS nb FROM (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem))"


@_query(f"SELECT round(t, 5) AS t, round(f, 2) AS df, round(pow(f / (f + t * t), f / 2), 5) AS p FROM (SELECT (ma - mb) / sqrt(sa + sb) AS t, (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) AS f FROM {_WELCH})")
def welch_t(spark, sf_dir):
    return stats.welch(_t(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice").select(r("t", 5).alias("t"), r("df", 2).alias("df"), r("p", 5).alias("p"))


@_query("WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g) SELECT round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 4) AS f, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within FROM s")
def anova_oneway(spark, sf_dir):
    return stats.anova(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select(r("f", 4).alias("f"), "df_between", "df_within")


@_query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY l_returnflag")
def linear_regression(spark, sf_dir):
    f = stats.linear_regression(F.col("l_quantity"), _price())
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(f["slope"], 4).alias("slope"), r(f["intercept"], 3).alias("intercept"), r(f["r_squared"]).alias("r_squared"))


@_query("SELECT p_partkey, round(exp(-0.5 * pow((p_size - 25.0) / 10, 2)) / (10 * sqrt(2 * pi())), 8) AS n_pdf, round(1 - exp(-0.1 * p_size), 8) AS e_cdf, round(0.1 * exp(-0.1 * p_size), 8) AS e_pdf, round(exp(p_size * ln(20.0) - 20 - lgamma(p_size + 1.0)), 8) AS p_pmf FROM part")
def densities(spark, sf_dir):
    s = F.col("p_size").cast("double")
    e = distributions.Exponential(0.1)
    return _t(spark, sf_dir, "part").select("p_partkey", r(distributions.Normal(25, 10).pdf(s), 8).alias("n_pdf"), r(e.cdf(s), 8).alias("e_cdf"), r(e.pdf(s), 8).alias("e_pdf"), r(distributions.Poisson(20).pmf(s), 8).alias("p_pmf"))


@_query(f"""SELECT p_partkey, round(p_size / 51.0, 6) AS normal, round(p_size / 51.0, 6) AS student, round(0.5 + c, 6) AS student_cdf, round(-ln(1 - p_size / 51.0) / 2, 6) AS exponential, round(q, 6) AS poisson_cdf
FROM part JOIN (SELECT s, {integral("exp(lgamma(3.0) - lgamma(2.5)) / sqrt(5 * pi()) * pow(1 + $t * $t / 5, -3)", "0", "s / 51.0")} AS c, (SELECT sum(exp(k * ln(20.0) - 20 - lgamma(k + 1.0))) FROM range(51) u(k) WHERE k <= s) AS q FROM (SELECT DISTINCT p_size AS s FROM part)) ON s = p_size""")
def quantiles(spark, sf_dir):
    """Cumulative and quantile functions: a quantile's cumulative share is what was asked for."""
    p, normal, student = F.col("p_size") / 51.0, distributions.Normal(), distributions.StudentT(0, 1, 5)
    return _t(spark, sf_dir, "part").select(
        "p_partkey", r(normal.cdf(normal.ppf(p))).alias("normal"), r(student.cdf(student.ppf(p))).alias("student"), r(student.cdf(p)).alias("student_cdf"),
        r(distributions.Exponential(2).ppf(p)).alias("exponential"), r(distributions.Poisson(20).cdf(F.col("p_size").cast("double"))).alias("poisson_cdf"),
    )


@_query("SELECT p_partkey, round(gamma(p_size / 10.0), 6) AS gamma, round(lgamma(p_size / 10.0), 6) AS ln_gamma FROM part")
def gamma_family(spark, sf_dir):
    s = F.col("p_size") / 10.0
    return _t(spark, sf_dir, "part").select("p_partkey", r(special.gamma(s)).alias("gamma"), r(special.ln_gamma(s)).alias("ln_gamma"))


@_query(f"""SELECT p_partkey, round(e, 6) AS erf, round(ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * pow(z, 4)) - 1 / (252 * pow(z, 6)) - down, 6) AS digamma
FROM part JOIN (SELECT s, s / 10.0 + 10 AS z, 2 / sqrt(pi()) * {integral("exp(-$t * $t)", "0", "s / 10.0")} AS e, (SELECT sum(1 / (s / 10.0 + k)) FROM range(10) u(k)) AS down FROM (SELECT DISTINCT p_size AS s FROM part)) ON s = p_size""")
def erf_digamma(spark, sf_dir):
    s = F.col("p_size") / 10.0
    return _t(spark, sf_dir, "part").select("p_partkey", r(special.erf(s)).alias("erf"), r(special.digamma(s)).alias("digamma"))


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


_PAIR = "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id = 0)"


@_query(f"SELECT vec_id, round(list_distance(v, w), 5) AS l2, round(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), 5) AS l1, round(pow(list_sum(list_transform(list_zip(v, w), lambda z: pow(abs(z[1] - z[2]), 3))), 1.0 / 3), 5) AS l3, round(list_cosine_similarity(v, w), 5) AS cosine, round(list_inner_product(v, w), 5) AS dot {_PAIR}")
def distances(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    first = e.filter("id = 0").select(F.col("v").alias("w"))
    j = e.crossJoin(F.broadcast(first))
    return j.select(F.col("id").alias("vec_id"), r(geometry.euclidean("v", "w"), 5).alias("l2"), r(geometry.manhattan("v", "w"), 5).alias("l1"), r(geometry.minkowski("v", "w", 3.0), 5).alias("l3"), r(geometry.cosine("v", "w"), 5).alias("cosine"), r(geometry.dot("v", "w"), 5).alias("dot"))


@_query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS d FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def cdist(spark, sf_dir):
    """Every vector whose id is divisible by 50 against every vector."""
    e = _vectors(spark, sf_dir)
    return geometry.cdist(e, e.filter("id % 50 = 0")).select("i", "j", r("d", 5).alias("d"))


@_query("SELECT j, CAST(k - 1 AS INTEGER) AS rank, i FROM (SELECT b.vec_id AS j, a.vec_id AS i, row_number() OVER (PARTITION BY b.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), a.vec_id) AS k FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE k <= 5")
def nearest(spark, sf_dir):
    """The five nearest vectors of each vector whose id is divisible by 50."""
    e = _vectors(spark, sf_dir)
    return geometry.nearest(e, e.filter("id % 50 = 0"), 5).select("j", "rank", "i")


_CELL = "(SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"


def _matrix(spark, sf_dir):
    """The whole vectors."""
    return matrix.Array(_vectors(spark, sf_dir).select(F.col("id").alias("row_id"), "v"))


@_query(f"SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.x * b.x) + 0.0, 4) AS x FROM {_CELL} a JOIN {_CELL} b USING (i) GROUP BY a.j, b.j")
def gram(spark, sf_dir):
    return _matrix(spark, sf_dir).gram_matrix().cells().select(F.col("i").cast("int").alias("i"), "j", r("x", 4).alias("x"))


@_query(f"SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(covar_samp(a.x, b.x) + 0.0, 6) AS x FROM {_CELL} a JOIN {_CELL} b USING (i) GROUP BY a.j, b.j")
def covariance_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).covariance().cells().select(F.col("i").cast("int").alias("i"), "j", r("x").alias("x"))


@_query(f"SELECT a.i, CAST(b.j AS INTEGER) AS j, round(sum(a.x * (a.j + 1) * (b.j + 2) / 10.0) + 0.0, 5) AS x FROM {_CELL} a, (SELECT unnest(range(3)) AS j) b GROUP BY a.i, b.j")
def matmul(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    w = matrix.Array([[(i + 1) * (j + 2) / 10 for j in range(3)] for i in range(a.ncols)])
    return (a @ w).cells().select("i", "j", r("x", 5).alias("x"))


@_query(f"SELECT CAST(j AS BIGINT) AS j, round(sum(x) + 0.0, 4) AS total, round(avg(x) + 0.0, 6) AS mean, round(var_samp(x), 6) AS var, round(stddev_samp(x) + 1e-8, 6) AS sd FROM {_CELL} GROUP BY j")
def column_statistics(spark, sf_dir):
    x = F.col("x")
    return _matrix(spark, sf_dir).cells().groupBy(F.col("j").cast("long").alias("j")).agg(r(F.sum(x), 4).alias("total"), r(F.avg(x)).alias("mean"), r(F.var_samp(x)).alias("var"), r(F.stddev_samp(x) + 1e-8).alias("sd"))


@_query(f"SELECT i AS idx, round(avg(x) + 0.0, 6) AS x FROM {_CELL} GROUP BY i")
def row_means(spark, sf_dir):
    return _matrix(spark, sf_dir).mean_axis1().df.select("idx", r("x").alias("x"))


@_query("SELECT CAST(j AS BIGINT) AS i, i AS j, round(x + 0.0, 6) AS x FROM (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)")
def transpose(spark, sf_dir):
    """Every row and component, in cells: no row of the result, as long as the table, is gathered."""
    cells = _vectors(spark, sf_dir).select("id", F.posexplode("v").alias("j", "x"))
    return cells.select(F.col("j").cast("long").alias("i"), F.col("id").alias("j"), r("x").alias("x"))


@_query(f"SELECT i, CAST(j AS INTEGER) AS j, round(2 * x + (j + 1) + 0.0, 6) AS x FROM {_CELL}")
def broadcast_add(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    row = matrix.Array([[float(j + 1) for j in range(a.ncols)]])
    return (a * 2 + row).cells().select("i", "j", r("x").alias("x"))


_ACT = {"relu": "greatest(x, 0)", "relu_deriv": "CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "selu": "1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END", "gelu": "0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))", "swish": "x / (1 + exp(-x))", "softplus": "ln(1 + exp(x))", "mish": "x * tanh(ln(1 + exp(x)))", "hardswish": "x * least(greatest(x + 3, 0), 6) / 6", "sigmoid_deriv": "1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x)))"}


@_query("SELECT c_custkey, " + ", ".join(f"round({e} + 0.0, 6) AS {n}" for n, e in _ACT.items()) + " FROM (SELECT c_custkey, c_acctbal / 2000 AS x FROM customer)")
def activations(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 2000).alias("x")).select("c_custkey", *[r(nn.ACTIVATIONS[n](F.col("x"))).alias(n) for n in _ACT])


_ROWS = f"(SELECT *, max(x) OVER (PARTITION BY i) AS top, avg(x) OVER (PARTITION BY i) AS mu, var_pop(x) OVER (PARTITION BY i) AS v FROM {_CELL})"


@_query(f"SELECT i, CAST(j AS INTEGER) AS j, round(exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY i), 6) AS soft, round(x - top - ln(sum(exp(x - top)) OVER (PARTITION BY i)), 6) AS log_soft, round((x - mu) / sqrt(v + 1e-5) + 0.0, 6) AS norm FROM {_ROWS}")
def row_normalisations(spark, sf_dir):
    d = _matrix(spark, sf_dir).df
    z = F.arrays_zip(nn.row_softmax("v").alias("s"), nn.row_log_softmax("v").alias("l"), nn.row_layer_norm("v").alias("n"))
    return d.select(F.col("row_id").alias("i"), F.posexplode(z).alias("j", "z")).select("i", "j", r("z.s").alias("soft"), r("z.l").alias("log_soft"), r("z.n").alias("norm"))


@_query("SELECT round(avg((p - t) * (p - t)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae, round(avg(CASE WHEN abs(p - t) <= 0.03 THEN 0.5 * (p - t) * (p - t) ELSE 0.03 * (abs(p - t) - 0.015) END), 8) AS huber, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS bce FROM (SELECT l_discount AS p, l_tax AS t, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, least(greatest(l_discount * 5, 1e-15), 1 - 1e-15) AS q FROM lineitem)")
def losses(spark, sf_dir):
    p, t = _discount(), F.col("l_tax")
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return _t(spark, sf_dir, "lineitem").agg(r(F.avg(nn.LOSSES["mse"](p, t))).alias("mse"), r(F.avg(nn.LOSSES["mae"](p, t))).alias("mae"), r(F.avg(nn.huber(p, t, 0.03)), 8).alias("huber"), r(F.avg(nn.bce(p * 5, y))).alias("bce"))


@_query(f"SELECT CAST(i // 2 AS BIGINT) AS i, CAST(j // 2 AS INTEGER) AS j, round(max(x) + 0.0, 6) AS most, round(avg(x) + 0.0, 6) AS mean FROM {_CELL} GROUP BY i // 2, j // 2")
def pooling(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    both = a.max_pool2d(2).cells().withColumnRenamed("x", "most").join(a.avg_pool2d(2).cells().withColumnRenamed("x", "mean"), ["i", "j"])
    return both.select("i", F.col("j").cast("int").alias("j"), r("most").alias("most"), r("mean").alias("mean"))


@_query()
def spectrum(spark, sf_dir):
    """The spectrum of the whole events series; a transform in SQL would take the square of its length."""
    e = _events(spark, sf_dir)
    return signal.long_fft(e.select("idx", F.col("x").alias("re"), F.lit(0.0).alias("im")), e.count()).select(F.col("idx").alias("k"), r("re", 3).alias("re"), r("im", 3).alias("im"))


@_query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, value AS x FROM events)
SELECT user_id AS series, b.t AS k, round(sqrt(pow(sum(a.x * cos(2 * pi() * ((a.t * b.t) % a.n) / a.n)), 2) + pow(sum(a.x * sin(2 * pi() * ((a.t * b.t) % a.n) / a.n)), 2)), 4) AS mag FROM s a JOIN s b USING (user_id) GROUP BY user_id, b.t""")
def fft_by_user(spark, sf_dir):
    """The spectrum of every user's series."""
    e = _t(spark, sf_dir, "events")
    return signal.magnitudes(signal.fft(e.select("user_id", "event_id", "value"), "user_id", "value", "event_id")).select("series", "k", r("mag", 4).alias("mag"))


def _conv(keep: str, shift: int) -> str:
    return f"WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS t, value AS x FROM events), k AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 0.25::DOUBLE), (3, -0.1::DOUBLE)) v(j, w)) SELECT t + j - {shift} AS idx, round(sum(x * w), 5) AS x FROM s, k GROUP BY t + j HAVING {keep}"


_KERNEL = [0.25, 0.5, 0.25, -0.1]


@_query(_conv("true", 0))
def convolve_full(spark, sf_dir):
    return signal.convolve(_events(spark, sf_dir), _KERNEL, "full").select("idx", r("x", 5).alias("x"))


@_query(_conv("t + j >= 1 AND t + j < 1 + (SELECT count(*) FROM s)", 1))
def convolve_same(spark, sf_dir):
    return signal.convolve(_events(spark, sf_dir), _KERNEL, "same").select("idx", r("x", 5).alias("x"))


@_query(_conv("t + j >= 3 AND t + j < (SELECT count(*) FROM s)", 3))
def convolve_valid(spark, sf_dir):
    return signal.convolve(_events(spark, sf_dir), _KERNEL, "valid").select("idx", r("x", 5).alias("x"))


@_query("SELECT round(sum((t1 - t0) * (x0 + x1) / 2), 4) AS area FROM (SELECT event_id * 0.5 AS t0, value AS x0, lead(event_id * 0.5) OVER (ORDER BY event_id) AS t1, lead(value) OVER (ORDER BY event_id) AS x1 FROM events)")
def trapezoid(spark, sf_dir):
    return ordered.trapezoid(_events(spark, sf_dir).withColumn("t", F.col("event_id") * 0.5), "t", "x").select(r("area", 4).alias("area"))


@_query("WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS x, count(*) OVER () AS n FROM events), m AS (SELECT *, CASE WHEN n % 2 = 0 THEN n - 2 ELSE n - 1 END AS m FROM s) SELECT round(sum(x * (CASE WHEN i > m THEN 0 WHEN i = 0 OR i = m THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.5 / 3 + CASE WHEN n % 2 = 0 AND i >= n - 2 THEN 0.25 ELSE 0 END)), 3) AS area FROM m")
def simpson(spark, sf_dir):
    return ordered.simpson(_events(spark, sf_dir), "x", 0.5).select(r("area", 3).alias("area"))


_POLY = ([0.0, 4000.0, 8000.0, 5000.0, 1000.0], [0.0, -2.0, 8.0, 20.0, 14.0])


@_query("WITH e(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({_POLY[0][i]}::DOUBLE, {_POLY[1][i]}::DOUBLE, {_POLY[0][i - 1]}::DOUBLE, {_POLY[1][i - 1]}::DOUBLE)" for i in range(5)) + ") SELECT c_custkey, count(*) FILTER ((y1 > c_nationkey) <> (y2 > c_nationkey) AND c_acctbal < (x2 - x1) * (c_nationkey - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM customer, e GROUP BY c_custkey")
def point_in_polygon(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", geometry.in_polygon(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), *_POLY).alias("inside"))


_CROSS = "(({1}.x - {0}.x) * ({2}.y - {0}.y) - ({1}.y - {0}.y) * ({2}.x - {0}.x))"


@_query(f"""WITH p AS (SELECT min(c_acctbal) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer GROUP BY c_nationkey UNION SELECT max(c_acctbal), CAST(c_nationkey AS DOUBLE) FROM customer GROUP BY c_nationkey)
SELECT x, y FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE (q.x, q.y) <> (p.x, p.y) AND NOT EXISTS (SELECT 1 FROM p o WHERE {_CROSS.format("p", "q", "o")} < 0 OR ({_CROSS.format("p", "q", "o")} = 0 AND (o.x - p.x) * (q.x - p.x) + (o.y - p.y) * (q.y - p.y) < 0)))""")
def convex_hull(spark, sf_dir):
    """Only the least and greatest balance of a nation can be corners, which is how SQL can check the hull of all points."""
    return spark.createDataFrame(geometry.convex_hull(_t(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey"), "x double, y double")


@_query("SELECT p_partkey, round(-p_size * 1.0, 6) AS x, round(p_retailprice, 6) AS y, round(p_size * 2.0, 6) AS z, round(p_size * 1.0 * 3 - p_size * 2 * 2, 6) AS cross_x FROM part")
def rotate_cross(spark, sf_dir):
    """A half turn about y, and a cross product."""
    s, p = F.col("p_size").cast("double"), F.col("p_retailprice")
    v = rotated(Quaternion(0, 0, 1, 0), s, p, -2 * s)
    c = geometry.cross(F.array(F.lit(0.0), s, 2 * s), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return _t(spark, sf_dir, "part").select("p_partkey", v.alias("v"), c.alias("c")).select("p_partkey", r("v.x").alias("x"), r("v.y").alias("y"), r("v.z").alias("z"), r(F.get("c", F.lit(0))).alias("cross_x"))


@_query("SELECT p_partkey, round(sin(u) * exp(u) + u * u, 6) AS value, round(cos(u) * exp(u) + sin(u) * exp(u) + 2 * u, 6) AS derivative FROM (SELECT p_partkey, p_size / 25.0 AS u FROM part)")
def dual_numbers(spark, sf_dir):
    u = Dual(F.col("p_size") / 25.0, F.lit(1.0))
    f = u.sin() * u.exp() + u**2
    return _t(spark, sf_dir, "part").select("p_partkey", r(f.value).alias("value"), r(f.derivative).alias("derivative"))


@_query("WITH d AS (SELECT l_quantity / 50 AS x, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-(0.3 * l_quantity / 50 - 0.1))) AS s FROM lineitem) SELECT round(avg(-(y * ln(s) + (1 - y) * ln(1 - s))), 6) AS loss, round(avg((s - y) * x), 6) AS dw, round(avg(s - y), 6) AS db FROM d")
def logistic_gradient(spark, sf_dir):
    """One aggregate gives the loss of a logistic model and both gradients."""
    x, y = F.col("l_quantity") / 50, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    w, b = Node(F.lit(0.3), {"w": F.lit(1.0)}), Node(F.lit(-0.1), {"b": F.lit(1.0)})
    s = (w * x + b).sigmoid()
    loss = -(s.log() * y + (1.0 - s).log() * (1 - y))
    return _t(spark, sf_dir, "lineitem").agg(r(F.avg(loss.column)).alias("loss"), r(F.avg(loss.slopes["w"])).alias("dw"), r(F.avg(loss.slopes["b"])).alias("db"))


@_query("SELECT round(sum(x), 4) AS total, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var, count(*) AS n FROM (SELECT sqrt(value) * 2 + 1 AS x FROM events WHERE value IS NOT NULL AND value >= 0) WHERE x > 3")
def lazy_pipeline(spark, sf_dir):
    x = _t(spark, sf_dir, "events").select(F.sqrt("value").alias("x")).select((F.col("x") * 2 + 1).alias("x")).filter(ieee.compare(F.col("x"), "gt", 3.0))
    return x.agg(r(reduce.total(F.col("x")), 4).alias("total"), r(reduce.mean(F.col("x"))).alias("mean"), r(reduce.pop_variance(F.col("x"))).alias("var"), F.count("*").alias("n"))


@_query("SELECT CAST(i AS BIGINT) AS idx, round(2 + i * 0.5, 6) AS x FROM (SELECT unnest(range(1000)) AS i)")
def arange(spark, sf_dir):
    return spark.range(1000).select(F.col("id").alias("idx"), r(2 + F.col("id") * 0.5).alias("x"))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1, 2")
def windowed_moments(spark, sf_dir):
    m = moments.windowed_moments(_t(spark, sf_dir, "events"), "ts", "value", "event_type", window="1 hour")
    return m.select("start", "event_type", "n", r("mean").alias("mean"), r(F.sqrt("var"), 5).alias("sd"), r("least").alias("least"), r("most").alias("most"))
