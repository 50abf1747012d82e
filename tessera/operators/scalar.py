"""Driver-side numbers: Scalar (strict domains), Complex, Dual (also over columns) and Quaternion."""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.special import digamma_value


class Scalar(float):
    """A float whose named functions raise ValueError outside their domain and whose divisions by 0 raise."""

    def to_python(self) -> float:
        return float(self)

    def is_nan(self) -> bool:
        return math.isnan(self)

    def is_inf(self) -> bool:
        return math.isinf(self)

    def is_finite(self) -> bool:
        return math.isfinite(self)

    def __bool__(self) -> bool:
        return self != 0 and not math.isnan(self)

    def clamp(self, lo: float, hi: float) -> Scalar:
        if lo > hi:
            raise ValueError("lower bound above upper bound")
        return self if self.is_nan() else Scalar(min(max(float(self), lo), hi))

    def signum(self) -> Scalar:
        return self if self.is_nan() or self == 0 else Scalar(math.copysign(1, self))

    def lerp(self, other: float, t: float) -> Scalar:
        return Scalar(self + t * (other - self))

    def pow(self, e: float) -> Scalar:
        return Scalar(math.pow(self, e))

    def log(self, base: float | None = None) -> Scalar:
        if self <= 0 or (base is not None and (base <= 0 or base == 1)):
            raise ValueError("log outside its domain")
        return Scalar(math.log(self) if base is None else math.log(self, base))

    def atan2(self, x: float) -> Scalar:
        return Scalar(math.atan2(self, x))

    def hypot(self, o: float) -> Scalar:
        return Scalar(math.hypot(self, o))

    def round(self) -> Scalar:
        return Scalar(math.copysign(math.floor(abs(self) + 0.5), self))

    def fract(self) -> Scalar:
        return Scalar(self - math.trunc(self))

    def __mod__(self, o):
        return Scalar(math.fmod(self, o)) if o else self._zero()

    def __rmod__(self, o):
        return Scalar(math.fmod(o, self)) if self != 0 else self._zero()

    @staticmethod
    def _zero():
        raise ZeroDivisionError("division by zero")

    def __pow__(self, o, mod=None):
        if mod is not None:
            raise TypeError("three-argument power")
        try:
            return Scalar(math.pow(self, o))
        except ValueError:
            return Scalar(math.nan)

    def __repr__(self) -> str:
        return f"Scalar({float(self)!r})"


def _named(f):
    return lambda self: Scalar(f(float(self)))


def _operator(name):
    f = getattr(float, name)
    return lambda self, *o: r if (r := f(self, *map(float, o))) is NotImplemented else Scalar(r)


for _n in ("sqrt", "exp", "log2", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "cbrt", "exp2", "ceil", "floor", "trunc"):
    setattr(Scalar, _n, _named(getattr(math, _n)))
Scalar.abs = _named(abs)
for _n in ("__add__", "__radd__", "__sub__", "__rsub__", "__mul__", "__rmul__", "__truediv__", "__rtruediv__", "__floordiv__", "__rfloordiv__", "__neg__", "__pos__", "__abs__"):
    setattr(Scalar, _n, _operator(_n))


class Complex(complex):
    """A complex number ordered by modulus, with the principal branches."""

    re, im = property(lambda s: s.real), property(lambda s: s.imag)

    @staticmethod
    def from_polar(r: float, theta: float) -> Complex:
        if r < 0:
            raise ValueError("negative modulus")
        return Complex(cmath.rect(r, theta))

    def abs(self) -> float:
        return abs(self)

    def arg(self) -> float:
        return cmath.phase(self)

    def to_polar(self) -> tuple[float, float]:
        return cmath.polar(self)

    def conjugate(self) -> Complex:
        return Complex(complex.conjugate(self))

    def __lt__(self, o):
        return abs(self) < abs(o)

    def __le__(self, o):
        return abs(self) <= abs(o)

    def __gt__(self, o):
        return abs(self) > abs(o)

    def __ge__(self, o):
        return abs(self) >= abs(o)

    def pow(self, o) -> Complex:
        if self == 0:
            if complex(o).real <= 0:
                raise ValueError("zero to a power without positive real part")
            return Complex(0)
        return Complex(cmath.exp(complex(o) * cmath.log(self)))


for _n in ("exp", "log", "sqrt", "sin", "cos"):
    setattr(Complex, _n, (lambda f: lambda self: Complex(f(self)))(getattr(cmath, _n)))
for _n in ("__add__", "__radd__", "__sub__", "__rsub__", "__mul__", "__rmul__", "__truediv__", "__rtruediv__", "__pow__", "__rpow__", "__neg__", "__pos__"):
    setattr(Complex, _n, (lambda f: lambda self, *o: r if (r := f(self, *map(complex, o))) is NotImplemented else Complex(r))(getattr(complex, _n)))


def _of(column, number):
    return lambda x: column(x) if isinstance(x, Column) else number(x)


_sin, _cos, _exp, _log = _of(F.sin, math.sin), _of(F.cos, math.cos), _of(F.exp, math.exp), _of(F.ln, math.log)


class Dual:
    """A value with its derivative.  Parts are floats or columns, so f(Dual(F.col("x"), 1)).derivative is a plan."""

    def __init__(self, value, derivative=0.0):
        self.value, self.derivative = value, derivative

    @staticmethod
    def _of(o) -> Dual:
        return o if isinstance(o, Dual) else Dual(o, 0.0)

    def __add__(self, o):
        o = Dual._of(o)
        return Dual(self.value + o.value, self.derivative + o.derivative)

    def __sub__(self, o):
        o = Dual._of(o)
        return Dual(self.value - o.value, self.derivative - o.derivative)

    def __rsub__(self, o):
        return Dual._of(o) - self

    def __mul__(self, o):
        o = Dual._of(o)
        return Dual(self.value * o.value, self.value * o.derivative + self.derivative * o.value)

    def __truediv__(self, o):
        o = Dual._of(o)
        if not isinstance(o.value, Column) and o.value == 0:
            raise ZeroDivisionError("division by zero")
        return Dual(self.value / o.value, (self.derivative * o.value - self.value * o.derivative) / (o.value * o.value))

    def __rtruediv__(self, o):
        return Dual._of(o) / self

    def __pow__(self, p: float):
        power = (lambda e: F.pow(self.value, F.lit(float(e)))) if isinstance(self.value, Column) else (lambda e: self.value**e)
        return Dual(power(p), p * power(p - 1) * self.derivative)

    def __neg__(self):
        return Dual(-self.value, -self.derivative)

    __radd__, __rmul__ = __add__, __mul__

    def sin(self):
        return Dual(_sin(self.value), _cos(self.value) * self.derivative)

    def cos(self):
        return Dual(_cos(self.value), -_sin(self.value) * self.derivative)

    def exp(self):
        return Dual(_exp(self.value), _exp(self.value) * self.derivative)

    def log(self):
        return Dual(_log(self.value), self.derivative / self.value)

    def erf(self):
        return Dual(math.erf(self.value), 2 / math.sqrt(math.pi) * math.exp(-self.value * self.value) * self.derivative)

    def gamma(self):
        g = math.gamma(self.value)
        return Dual(g, g * digamma_value(self.value) * self.derivative)

    def __repr__(self) -> str:
        return f"Dual({self.value}, {self.derivative})"


def find_root_newton(f, x0: float, tol: float = 1e-10, max_iter: int = 100) -> float:
    """A root of f, a function of a Dual, by Newton's method."""
    x = float(x0)
    for _ in range(max_iter):
        y = f(Dual(x, 1.0))
        if abs(y.value) < tol:
            return x
        if y.derivative == 0:
            raise ValueError("zero derivative")
        x -= y.value / y.derivative
    raise ValueError("no convergence")


def integrate_simpson(f, a: float, b: float, n: int = 100) -> float:
    """Simpson's rule for a Python function on n (even) intervals."""
    if n <= 0 or n % 2:
        raise ValueError("n must be positive and even")
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


class Quaternion:
    def __init__(self, w: float, x: float, y: float, z: float):
        self.w, self.x, self.y, self.z = map(float, (w, x, y, z))

    def norm(self) -> float:
        return math.sqrt(self.w**2 + self.x**2 + self.y**2 + self.z**2)

    def normalize(self) -> Quaternion:
        n = self.norm()
        return Quaternion(self.w / n, self.x / n, self.y / n, self.z / n) if n else self

    def __mul__(self, o: Quaternion) -> Quaternion:
        (a, b, c, d), (e, f, g, h) = (self.w, self.x, self.y, self.z), (o.w, o.x, o.y, o.z)
        return Quaternion(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)

    def rotate_vector(self, v) -> list[float]:
        if len(v) != 3:
            raise ValueError("three components are needed")
        r = self * Quaternion(0, *v) * Quaternion(self.w, -self.x, -self.y, -self.z)
        return [r.x, r.y, r.z]

    def __repr__(self) -> str:
        return f"Quaternion({self.w}, {self.x}, {self.y}, {self.z})"


def rotated(q: Quaternion, x, y, z) -> Column:
    """The columns x, y, z rotated by q, as a struct: a constant matrix product for every row."""
    columns = [q.rotate_vector(e) for e in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    return F.struct(*[(columns[0][i] * x + columns[1][i] * y + columns[2][i] * z).alias(n) for i, n in enumerate("xyz")])
