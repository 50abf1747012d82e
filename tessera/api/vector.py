"""Constructors and functions of vectors.  mean, min and max (also as vmin, vmax) of no numbers raise ValueError."""

import math

from tessera.operators.vector import Vector

rand, randn, arange, range, linspace, zeros, ones, full, sum_range = Vector.random, Vector.randn, Vector.arange, Vector.range, Vector.linspace, Vector.zeros, Vector.ones, Vector.full, Vector.sum_range
rand_seeded, randn_seeded = Vector.random, Vector.randn


def _of(name: str, some: bool = False):
    method = getattr(Vector, name)

    def call(v: Vector, *args):
        out = method(v, *args)
        if some and math.isnan(out):
            raise ValueError(f"{name} of no numbers")
        return out

    call.__name__ = name
    return call


for _n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "exp", "exp2", "expm1", "log", "log2", "log10", "log1p", "sqrt", "cbrt", "abs", "ceil", "floor", "round", "trunc", "fract", "signum", "recip"):
    globals()[_n] = _of(_n)
for _n in ("prod", "variance", "pop_variance", "std_dev", "pop_std_dev", "median", "percentile", "argmin", "argmax", "norm", "norm_l1", "norm_inf", "norm_lp", "dot"):
    globals()[_n] = _of(_n)
for _n in ("add_scalar", "sub_scalar", "mul_scalar", "div_scalar", "pow_scalar", "clamp", "add_vec", "sub_vec", "mul_vec", "div_vec", "isnan", "isfinite", "isinf", "is_integer", "is_prime"):
    globals()[_n] = _of(_n)
vsum, mean, vmin, vmax = _of("sum"), _of("mean", True), _of("min", True), _of("max", True)
