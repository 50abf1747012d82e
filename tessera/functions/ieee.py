"""Column expressions with IEEE-754 results where Spark's own raise, return NULL or order NaN otherwise.

Everything here is a built-in expression, so it stays inside whole-stage code generation and can be pushed down.
"""

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def nan() -> Column:
    return F.lit(NAN)


def div(a, b) -> Column:
    """a / b: x/0 is an infinity of x's sign, 0/0 is NaN.  The sign of a zero divisor is not looked at."""
    a, b = lit(a), lit(b)
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.isnan(a) | (a == 0), nan()).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))


def mod(a, b) -> Column:
    """The remainder with the sign of a; x % 0 is NaN."""
    a, b = lit(a), lit(b)
    return F.when(b == 0, nan()).otherwise(F.try_mod(a, b))


def floordiv(a, b) -> Column:
    return floor(div(a, b))


def isfinite(x) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def isinf(x) -> Column:
    return F.abs(x) == INF


def is_integer(x) -> Column:
    return isfinite(x) & (x == F.rint(x))


def _log(f, x, shift: float = 0.0) -> Column:
    edge = -shift
    return F.when(F.isnan(x) | (x < edge), nan()).when(x == edge, F.lit(-INF)).otherwise(f(x))


def ln(x) -> Column:
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log1p(x) -> Column:
    return _log(F.log1p, x, 1.0)


def _whole(f, x) -> Column:
    # Beyond 2**52 every double is whole; there and for NaN and infinities x is its own result.
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(f(x).cast("double"))


def floor(x) -> Column:
    return _whole(F.floor, x)


def ceil(x) -> Column:
    return _whole(F.ceil, x)


def round_(x) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.when(x < 0, -_whole(F.floor, -x + 0.5)).otherwise(_whole(F.floor, x + 0.5))


def trunc(x) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def clamp(x, lo: float, hi: float) -> Column:
    if lo > hi:
        raise ValueError("lower bound above upper bound")
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def rounded_to(x, dtype: str) -> Column:
    """x rounded, half to even, to what float32 or float16 holds; beyond the largest it is infinite."""
    if dtype == "float32":
        return x.cast("float").cast("double")
    # Ten bits behind the leading one, and 2^-24 as the least step.
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)).cast("double") - 10)
    near = F.rint(x / step) * step
    return F.when(F.isnan(x) | (x == 0), x).when(F.abs(x) >= 65520, F.signum(x) * F.lit(math.inf)).otherwise(near)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-x))


_COMPARE = {"gt": operator.gt, ">": operator.gt, "lt": operator.lt, "<": operator.lt, "ge": operator.ge, ">=": operator.ge, "le": operator.le, "<=": operator.le, "eq": operator.eq, "==": operator.eq, "ne": operator.ne, "!=": operator.ne}


def compare(x, op: str, threshold) -> Column:
    """An IEEE comparison: false where either side is NaN, but for `ne`, which is true there."""
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    test = _COMPARE[op](x, threshold)
    numbers = ~F.isnan(x) if not isinstance(threshold, Column) else ~F.isnan(x) & ~F.isnan(threshold)
    return (test | ~numbers) if op in ("ne", "!=") else (test & numbers)


def predicate(conditions, mode: str = "all") -> Column:
    """One predicate of [(column, op, threshold)]: their conjunction, or with mode "any" their disjunction."""
    tests = [compare(F.col(c) if isinstance(c, str) else c, op, t) for c, op, t in conditions]
    if not tests:
        return F.lit(mode != "any")
    return reduce(operator.or_ if mode == "any" else operator.and_, tests)


def is_prime(x) -> Column:
    """Primality of |round(x)| up to 10**6 by trial division as one expression; longer numbers go through a sequence."""
    n = F.abs(round_(x)).cast("long")
    root = F.sqrt(n.cast("double")).cast("long") + 1
    divisors = F.sequence(F.lit(2).cast("long"), F.greatest(F.least(root, n - 1), F.lit(2).cast("long")))
    return F.when(~isfinite(x), F.lit(False)).when(n < 2, F.lit(False)).when(n < 4, F.lit(True)).otherwise(~F.exists(divisors, lambda d: n % d == 0))


#: Elementwise functions of one column, by name; arrays use them through transform.
ELEMENTWISE = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "exp": F.exp,
    "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1, "log": ln, "log2": log2, "log10": log10, "log1p": log1p, "abs": F.abs,
    "ceil": ceil, "floor": floor, "round": round_, "trunc": trunc, "fract": lambda x: x - trunc(x), "signum": F.signum,
    "recip": lambda x: div(1.0, x), "sigmoid": sigmoid, "neg": lambda x: -x, "degrees": F.degrees, "radians": F.radians,
    "remainder_pi": lambda x: mod(x, 3.141592653589793), "inv_sqrt": lambda x: div(1.0, F.sqrt(x)),
}
#: Mathematical constants (fixed values).
PI, TAU, E, PHI = 3.141592653589793, 6.283185307179586, 2.718281828459045, 1.618033988749895
SQRT_2, SQRT_3, SQRT_5, SQRT_1_2 = 1.4142135623730951, 1.7320508075688772, 2.23606797749979, 0.7071067811865476
LN_2, LN_10, LOG2_E, LOG10_E = 0.6931471805599453, 2.302585092994046, 1.4426950408889634, 0.4342944819032518
EPSILON_F32, EPSILON_F64, MAX_F32, MAX_F64, MIN_POSITIVE_F64 = 2.0**-23, 2.0**-52, 3.4028234663852886e38, 1.7976931348623157e308, 2.2250738585072014e-308
