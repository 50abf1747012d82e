"""Distances between array columns, pairwise searches, polygons and hulls."""


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ieee


def _sum(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a, b, p: float) -> Column:
    return F.pow(_sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1 / p))


def cosine(a, b) -> Column:
    """0 where a norm is 0."""
    den = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(den > 0, dot(a, b) / F.when(den > 0, den)).otherwise(0.0)


def angle(a, b) -> Column:
    return F.acos(ieee.clamp(cosine(a, b), -1, 1))


def projection(v, t) -> Column:
    """v's part along t; t itself where t is zero."""
    den = dot(t, t)
    k = F.when(den > 0, dot(v, t) / F.when(den > 0, den)).otherwise(1.0)
    return F.transform(t, lambda x: x * k)


def cross(a, b) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def cdist(a: DataFrame, b: DataFrame, most_right: int = 100_000) -> DataFrame:
    """(i, j, d) for all rows (id, v) of a and b.  Every pair is the result asked for; b is broadcast after a check of its
    count, and a larger b is taken in blocks."""
    n = b.count()
    left, out = a.select(F.col("id").alias("i"), F.col("v").alias("_a")), None
    for k in range(max(1, -(-n // most_right))):
        part = b if n <= most_right else b.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // most_right))) == k)
        pairs = left.crossJoin(F.broadcast(part.select(F.col("id").alias("j"), F.col("v").alias("_b"))))
        pairs = pairs.select("i", "j", euclidean("_a", "_b").alias("d"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def nearest(a: DataFrame, queries: DataFrame, k: int, most_right: int = 100_000) -> DataFrame:
    """(j, rank, i, d): the k rows of a nearest to each query, the smaller id first on ties.

    The rank is a window limited to k: Spark keeps the k best rows of a query in each task before the shuffle and again
    behind it, so k rows a task and query travel and no list of pairs is ever gathered."""
    place = Window.partitionBy("j").orderBy("d", "i")
    pairs = cdist(a, queries, most_right).withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k)
    return pairs.select("j", (F.col("_r") - 1).alias("rank"), "i", "d")


def in_polygon(x, y, poly_x, poly_y) -> Column:
    """Ray casting against a constant polygon; fewer than three vertices hold no point."""
    n = len(poly_x)
    if n < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for i in range(n):
        x1, y1, x2, y2 = *map(float, (poly_x[i], poly_y[i])), *map(float, (poly_x[i - 1], poly_y[i - 1]))
        if y1 != y2:
            crossings = crossings + F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise from the lowest x (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def convex_hull(df: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """The hull of a table's points: each task reduces its rows to their hull, and the hull of those few is taken here."""

    def local(batches):
        import pandas as pd

        kept = []
        for b in batches:
            kept = hull_of(kept + list(zip(b["x"].astype(float), b["y"].astype(float), strict=True)))
        yield pd.DataFrame(kept, columns=["x", "y"])

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().mapInPandas(local, "x double, y double").collect()
    return hull_of([(r.x, r.y) for r in rows])


