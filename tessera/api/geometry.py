"""Distances and angles of vectors, polygons, hulls and rotations."""

from pyspark.sql import functions as F

from tessera.api import as_array, as_vector
from tessera.functions import ieee
from tessera.operators import geometry as plans
from tessera.operators.matrix import Array
from tessera.operators.scalar import Quaternion
from tessera.operators.vector import Vector

__all__ = ["Quaternion", "angle_between", "cdist", "convex_hull", "cosine_similarity", "cross_product", "euclidean_distance", "is_point_in_polygon", "manhattan_distance", "minkowski_distance", "projection"]


def _pairs(a, b):
    """Both vectors side by side; lengths must match."""
    return as_vector(a)._zip(as_vector(b))


def _one(a, b, f) -> float:
    """f of the columns of a and b, an aggregate; 0 of no rows."""
    return _pairs(a, b).agg(F.coalesce(f(F.col("x"), F.col("y")), F.lit(0.0)).alias("r")).first().r


def euclidean_distance(a, b) -> float:
    return _one(a, b, lambda x, y: F.sqrt(F.sum((x - y) * (x - y))))


def manhattan_distance(a, b) -> float:
    return _one(a, b, lambda x, y: F.sum(F.abs(x - y)))


def minkowski_distance(a, b, p: float) -> float:
    return _one(a, b, lambda x, y: F.pow(F.sum(F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1 / p)))


def _cosine(x, y):
    den = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return F.when(den > 0, F.sum(x * y) / F.when(den > 0, den)).otherwise(0.0)


def cosine_similarity(a, b) -> float:
    """0 where a norm is 0."""
    return _one(a, b, _cosine)


def angle_between(a, b) -> float:
    return _one(a, b, lambda x, y: F.acos(ieee.clamp(_cosine(x, y), -1, 1)))


def projection(v, target) -> Vector:
    """v's part along target; target itself where that is zero."""
    t, v = as_vector(target), as_vector(v)
    den, num = t.dot(t), v.dot(t)
    return t * (num / den) if den > 0 else t


def cross_product(a, b) -> Vector:
    a, b = as_vector(a).to_list(), as_vector(b).to_list()
    if len(a) != 3 or len(b) != 3:
        raise ValueError("three components are needed")
    return Vector([a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def cdist(a, b) -> Array:
    return as_array(a).cdist(as_array(b))


def is_point_in_polygon(x: float, y: float, poly_x, poly_y) -> bool:
    """Ray casting; fewer than three vertices hold no point."""
    n, inside = len(poly_x), False
    for i in range(n if n > 2 else 0):
        x1, y1, x2, y2 = poly_x[i], poly_y[i], poly_x[i - 1], poly_y[i - 1]
        inside ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return inside


def convex_hull(x, y=None) -> list[tuple[float, float]]:
    """The hull of points given as two vectors, or as rows of an array of two columns."""
    if y is None:
        a = as_array(x)
        return plans.convex_hull(a.df.select(F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y")), "x", "y")
    return plans.convex_hull(_pairs(x, y), "x", "y")
