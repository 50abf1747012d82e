"""Numbers: Scalar and Complex, lazy pipelines over ranges, constants as Scalars, and free functions of floats."""

import math

from tessera.operators.lazy import LazyPipeline, from_list, linspace, loop_range, zeros
from tessera.operators.scalar import Complex, Scalar

__all__ = ["Complex", "LazyPipeline", "Scalar", "from_list", "linspace", "loop_range", "zeros"]

pi, e, tau, sqrt2, ln2, ln10, inf, nan = map(Scalar, (math.pi, math.e, math.tau, math.sqrt(2), math.log(2), math.log(10), math.inf, math.nan))
remainder, fmod, copysign, nextafter, degrees, radians, frexp, ulp, isclose, factorial, gcd, lcm = (
    math.remainder, math.fmod, math.copysign, math.nextafter, math.degrees, math.radians, math.frexp, math.ulp, math.isclose, math.factorial, math.gcd, math.lcm,
)


def round_half_even(x: float) -> float:
    return float(round(x)) if math.isfinite(x) else x


def inv_sqrt(x: float) -> float:
    if x <= 0:
        raise ValueError("no positive number")
    return 1 / math.sqrt(x)


def root(x: float, n: int) -> float:
    """The real n-th root."""
    if n == 0 or (x < 0 and n % 2 == 0):
        raise ValueError("no real root")
    return math.copysign(abs(x) ** (1 / n), x)


def logsumexp2(a: float, b: float) -> float:
    top = max(a, b)
    return top if math.isinf(top) else top + math.log1p(math.exp(min(a, b) - top))


def hypot_3d(x: float, y: float, z: float) -> float:
    return math.hypot(x, y, z)


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))
