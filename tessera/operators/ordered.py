"""Running operators over an explicit order, in two levels, so no global window gathers all rows in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.store import stored

BLOCK = 1 << 20


def with_index(df: DataFrame, *order, name: str = "idx") -> DataFrame:
    """df with a dense index 0, 1, ... in the given order: a range sort, then offsets from the counts of its partitions.

    The sorted rows are written once, with their partition and place.  Counts and offsets are read from that copy: a plan
    run twice may draw other range borders, and offsets of one run do not fit the rows of another.
    """
    at = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition of the sort.
    sizes = at.groupBy(part.alias("_p")).count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return at.withColumn("_p", part).join(F.broadcast(sizes), "_p").withColumn(name, F.col("_before") + inside).drop("_m", "_p", "_before")


def quantiles(df: DataFrame, x: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each name: the exact quantile of x at that share, from 0 to 1, linear between neighbours;
    null of no rows.  Rows are sorted and numbered and two are picked for each share; nulls do not count."""
    at = with_index(df.select(F.col(x).alias("_x")).filter("_x is not null"), "_x", name="_i")
    n = at.agg(F.count("*").alias("_n"))
    place = {k: (F.col("_n") - 1) * F.lit(float(q)) for k, q in shares.items()}
    pick = lambda p, side: F.max(F.when(F.col("_i") == side(p), F.col("_x")))
    both = at.crossJoin(F.broadcast(n)).agg(F.first("_n").alias("_n"), *[pick(p, f).alias(f"_{s}{k}") for k, p in place.items() for s, f in (("l", F.floor), ("h", F.ceil))])
    low, high, part = (lambda k: F.col(f"_l{k}")), (lambda k: F.col(f"_h{k}")), (lambda k: place[k] - F.floor(place[k]))
    return both.select(*[F.when(low(k) == high(k), low(k)).otherwise((1 - part(k)) * low(k) + part(k) * high(k)).alias(k) for k in shares])


def reindex(df: DataFrame, by: str, name: str = "idx", block: int = BLOCK) -> DataFrame:
    """df, in which `by` holds distinct longs, with a dense index 0, 1, ... in the order of `by`, which goes.

    A row's block depends on its own value alone, so no plan run twice can disagree; a block holds `block` rows at most.
    """
    marked = df.withColumn("_b", F.floor(F.col(by) / block))
    # One row for each block of values.
    sizes = marked.groupBy("_b").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return marked.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(by)) - 1).join(sizes, "_b").withColumn(name, F.col("_before") + F.col("_r")).drop("_b", "_r", "_before", *([by] if by != name else []))


def running(df: DataFrame, total, combine, out: str, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """A running aggregate along a dense index: total(frame) is the aggregate over a window, combine joins two values.

    Blocks of consecutive indices run in parallel; what comes before a block is a running total over block totals, of
    which there is one for `block` rows.
    """
    blocked = df.withColumn("_b", F.floor(F.col(idx) / block))
    here = Window.partitionBy("_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = blocked.groupBy("_b").agg(total(None).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", total("_t").over(before)).select("_b", "_before")
    return blocked.withColumn("_here", total(None).over(here)).join(ends, "_b").withColumn(out, F.when(F.col("_before").isNull(), F.col("_here")).otherwise(combine(F.col("_before"), F.col("_here")))).drop("_b", "_here", "_before")


def cumsum(df: DataFrame, x: str = "x", out: str = "x", idx: str = "idx") -> DataFrame:
    return running(df, lambda c: F.sum(c or x), lambda a, b: a + b, out, idx)


def cumprod(df: DataFrame, x: str = "x", out: str = "x", idx: str = "idx") -> DataFrame:
    return running(df, lambda c: F.product(F.col(c or x)), lambda a, b: a * b, out, idx)


def with_next(df: DataFrame, columns, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """df with next_<c> for each column: the value one index on (null at the end).  A block's first row also serves the
    block before it."""
    own = df.withColumn("_b", F.floor(F.col(idx) / block)).withColumn("_own", F.lit(True))
    lent = df.filter((F.col(idx) % block == 0) & (F.col(idx) > 0)).withColumn("_b", F.floor(F.col(idx) / block) - 1).withColumn("_own", F.lit(False))
    by = Window.partitionBy("_b").orderBy(idx)
    out = own.unionByName(lent)
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(by))
    return out.filter("_own").drop("_b", "_own")


def diff(df: DataFrame, x: str = "x", idx: str = "idx") -> DataFrame:
    """(idx, x): x[i + 1] - x[i], one row fewer."""
    return with_next(df.select(idx, x), [x], idx).filter(F.col(f"next_{x}").isNotNull()).select(F.col(idx), (F.col(f"next_{x}") - F.col(x)).alias(x))


def trapezoid(df: DataFrame, x: str, y: str, idx: str = "idx") -> DataFrame:
    """One row `area`: sum of dx (y0 + y1) / 2; fewer than two rows give 0."""
    steps = with_next(df.select(idx, x, y), [x, y], idx)
    return steps.agg(F.coalesce(F.sum((F.col(f"next_{x}") - F.col(x)) * (F.col(y) + F.col(f"next_{y}")) / 2), F.lit(0.0)).alias("area"))


def simpson(df: DataFrame, y: str, dx: float, idx: str = "idx") -> DataFrame:
    """One row `area`: the 1/3 rule on 0..n-1; for an even count it ends at n-2 and a trapezoid follows."""
    n = F.max(idx).cast("long") + 1
    last = df.agg(n.alias("n"))
    m = F.when(F.col("n") % 2 == 0, F.col("n") - 2).otherwise(F.col("n") - 1)
    i = F.col(idx)
    weight = F.when(i > m, 0.0).when((i == 0) | (i == m), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * (dx / 3)
    tail = F.when((F.col("n") % 2 == 0) & (i >= F.col("n") - 2), dx / 2).otherwise(0.0)
    return df.crossJoin(F.broadcast(last)).agg(F.when(F.max("n") < 3, F.lit(None)).otherwise(F.sum((weight + tail) * F.col(y))).alias("area"))
