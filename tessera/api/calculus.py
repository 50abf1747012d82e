"""Integrals of sampled and of callable functions, roots and dual numbers."""

from tessera.api import as_vector
from tessera.operators import ordered
from tessera.operators.scalar import Dual, find_root_newton, integrate_simpson

__all__ = ["Dual", "find_root_newton", "integrate_simpson", "integrate_simpson_array", "integrate_trapezoidal"]


def integrate_trapezoidal(x, y) -> float:
    return ordered.trapezoid(as_vector(x)._zip(as_vector(y)), "x", "y").first().area


def integrate_simpson_array(y, dx: float) -> float:
    """The 1/3 rule on samples dx apart; three or more are needed."""
    v = as_vector(y)
    if len(v) < 3:
        raise ValueError("three samples are needed")
    return ordered.simpson(v.df, "x", dx).first().area
