"""Vector: an ordered column of doubles, as a lazy DataFrame (idx, x) with a dense index."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.operators import ordered, reduce

MOST_COLLECTED = 250_000_000


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Vector:
    """Operations build plans; only reductions, conversions and printing run them."""

    def __init__(self, data, size: int | None = None):
        if isinstance(data, DataFrame):
            self.df, self._size = data.select(F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x")), size
        else:
            values = [float(v) for v in data]
            rows = _spark().createDataFrame([(values,)], "v array<double>").select(F.posexplode("v").alias("idx", "x"))
            self.df, self._size = rows.select(F.col("idx").cast("long").alias("idx"), "x"), len(values)

    # Constructors
    @classmethod
    def _range(cls, n: int, x: Column) -> Vector:
        return cls(_spark().range(n).select(F.col("id").alias("idx"), x.alias("x")), n)

    @classmethod
    def from_table(cls, df: DataFrame, x, *order) -> Vector:
        return cls(ordered.with_index(df.select(F.col(x) if isinstance(x, str) else x, *[o for o in order if o != x]).toDF("x", *[f"o{i}" for i, o in enumerate([o for o in order if o != x])]), *[f"o{i}" if o != x else "x" for i, o in enumerate(order)]))

    @classmethod
    def full(cls, n: int, value: float) -> Vector:
        return cls._range(n, F.lit(float(value)))

    @classmethod
    def zeros(cls, n: int) -> Vector:
        return cls.full(n, 0.0)

    @classmethod
    def ones(cls, n: int) -> Vector:
        return cls.full(n, 1.0)

    @classmethod
    def random(cls, n: int, seed: int | None = None) -> Vector:
        return cls._range(n, F.rand(seed) if seed is not None else F.rand())

    rand = rand_seeded = random

    @classmethod
    def randn(cls, n: int, seed: int | None = None) -> Vector:
        return cls._range(n, F.randn(seed) if seed is not None else F.randn())

    randn_seeded = randn

    @classmethod
    def arange(cls, start: float, stop: float | None = None, step: float = 1.0) -> Vector:
        start, stop = (0.0, start) if stop is None else (start, stop)
        n = max(0, math.ceil((stop - start) / step)) if step else 0
        return cls._range(n, F.lit(float(start)) + F.col("id") * float(step))

    range = arange

    @classmethod
    def linspace(cls, start: float, stop: float, num: int) -> Vector:
        step = (stop - start) / (num - 1) if num > 1 else 0.0
        return cls._range(num, F.lit(float(start)) + F.col("id") * step)

    @staticmethod
    def sum_range(start: float, stop: float | None = None, step: float = 1.0) -> float:
        start, stop = (0.0, start) if stop is None else (start, stop)
        n = max(0, math.ceil((stop - start) / step)) if step else 0
        return n / 2 * (2 * start + (n - 1) * step)

    # Sequence protocol and conversion
    def __len__(self) -> int:
        if self._size is None:
            self._size = self.df.count()
        return self._size

    @property
    def size(self) -> int:
        return len(self)

    @property
    def shape(self) -> list[int]:
        return [len(self)]

    ndim = 1

    def _bounded(self, most: int = MOST_COLLECTED) -> None:
        if len(self) > most:
            raise MemoryError(f"{len(self)} elements; collecting is limited to {most}")

    def to_list(self, most: int = MOST_COLLECTED) -> list[float]:
        self._bounded(most)
        return [r.x for r in self.df.orderBy("idx").collect()]

    tolist = to_list

    def to_numpy(self) -> np.ndarray:
        return np.array(self.to_list())

    def __array__(self, dtype=None, copy=None):
        return self.to_numpy().astype(dtype or float)

    def into_array(self):
        """A matrix of one row."""
        from tessera.operators.matrix import Array

        return Array([self.to_list()])

    def __iter__(self):
        return (r.x for r in self.df.orderBy("idx").toLocalIterator())

    def __contains__(self, value) -> bool:
        return not self.df.filter(ieee.compare(F.col("x"), "eq", float(value))).limit(1).isEmpty()

    def __getitem__(self, key):
        n = len(self)
        if isinstance(key, slice):
            a, b, s = key.indices(n)
            if s <= 0:
                raise ValueError("step must be positive")
            i = F.col("idx")
            return Vector(self.df.filter((i >= a) & (i < b) & ((i - a) % s == 0)).select(F.floor((i - a) / s).alias("idx"), "x"), max(0, -(-(b - a) // s)))
        k = key + n if key < 0 else key
        if not 0 <= k < n:
            raise IndexError(key)
        return self.df.filter(F.col("idx") == k).first().x

    def with_item(self, key: int, value: float) -> Vector:
        return self._map(F.when(F.col("idx") == (key + len(self) if key < 0 else key), float(value)).otherwise(F.col("x")))

    def __setitem__(self, key: int, value: float) -> None:
        self.df = self.with_item(key, value).df

    def __repr__(self) -> str:
        n = len(self)
        if n <= 10:
            return f"Vector({self.to_list()})"
        return f"Vector([{self[0]}, {self[1]}, ..., {self[n - 1]}], len={n})"

    __str__ = __repr__

    def lazy(self):
        """A LazyPipeline over this vector."""
        from tessera.operators.lazy import LazyPipeline

        return LazyPipeline(self)

    # Elementwise
    def _map(self, x: Column) -> Vector:
        return Vector(self.df.select("idx", x.alias("x")), self._size)

    def _zip(self, other: Vector) -> DataFrame:
        if len(self) != len(other):
            raise ValueError("length mismatch")
        return self.df.join(other.df.withColumnRenamed("x", "y"), "idx")

    def _with(self, other, f) -> Vector:
        if isinstance(other, Vector):
            return Vector(self._zip(other).select("idx", f(F.col("x"), F.col("y")).alias("x")), self._size)
        return self._map(f(F.col("x"), F.lit(float(other))))

    def _divided(self, other, f) -> Vector:
        if not isinstance(other, Vector) and float(other) == 0:
            raise ZeroDivisionError("division by zero")
        return self._with(other, f)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._with(o, lambda a, b: b - a)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._divided(o, ieee.div)

    def __rtruediv__(self, o):
        return self._with(o, lambda a, b: ieee.div(b, a))

    def __floordiv__(self, o):
        return self._divided(o, ieee.floordiv)

    def __rfloordiv__(self, o):
        return self._with(o, lambda a, b: ieee.floordiv(b, a))

    def __mod__(self, o):
        return self._divided(o, ieee.mod)

    def __rmod__(self, o):
        return self._with(o, lambda a, b: ieee.mod(b, a))

    def __pow__(self, o):
        return self._with(o, F.pow)

    def __rpow__(self, o):
        return self._with(o, lambda a, b: F.pow(b, a))

    def __neg__(self):
        return self._map(-F.col("x"))

    def __pos__(self):
        return self

    def __abs__(self):
        return self._map(F.abs("x"))

    __radd__, __rmul__ = __add__, __mul__
    add = add_vec = add_scalar = __add__
    sub = sub_vec = sub_scalar = __sub__
    mul = mul_vec = mul_scalar = __mul__
    div = div_vec = div_scalar = __truediv__
    pow = pow_scalar = __pow__

    def clamp(self, lo: float, hi: float) -> Vector:
        return self._map(ieee.clamp(F.col("x"), lo, hi))

    clip = clamp

    def hypot_scalar(self, y: float) -> Vector:
        return self._map(F.hypot("x", F.lit(float(y))))

    def atan2_scalar(self, x: float) -> Vector:
        return self._map(F.atan2("x", F.lit(float(x))))

    def lerp_scalar(self, other: float, t: float) -> Vector:
        return self._map(F.col("x") + t * (other - F.col("x")))

    def map(self, f) -> Vector:
        """f takes and gives a column."""
        return self._map(f(F.col("x")))

    def zip_map(self, other: Vector, f) -> Vector:
        return self._with(other, f)

    # Reductions
    def _one(self, c: Column):
        return self.df.agg(c.alias("r")).first().r

    def dot(self, other: Vector) -> float:
        return self._zip(other).agg(reduce.dot(F.col("x"), F.col("y")).alias("r")).first().r

    def _quantiles(self, **shares: float) -> tuple[float, ...]:
        return tuple(math.nan if v is None else v for v in ordered.quantiles(self.df, "x", shares).first())

    def percentile(self, q: float) -> float:
        if not 0 <= q <= 100:
            raise ValueError("q outside [0, 100]")
        return self._quantiles(p=q / 100)[0]

    def median(self) -> float:
        return self._quantiles(p=0.5)[0]

    def norm_lp(self, p: float) -> float:
        return self._one(reduce.norm_lp(F.col("x"), p))

    def argmin(self) -> int:
        return self._one(reduce.argmin(F.col("x"), F.col("idx")))

    def argmax(self) -> int:
        return self._one(reduce.argmax(F.col("x"), F.col("idx")))

    def describe(self, compat: bool = False) -> dict[str, float]:
        return self.df.agg(*[c.alias(k) for k, c in reduce.moments(F.col("x"), compat).items()]).first().asDict()

    def mode(self) -> float:
        return reduce.mode(self.df, "x", "idx").first().mode

    def mad(self) -> float:
        return reduce.mad(self.df, "x").first().mad

    def iqr(self) -> float:
        low, high = self._quantiles(a=0.25, b=0.75)
        return high - low

    def standardize(self) -> Vector:
        """(x - mean) / sample deviation; unchanged where that is 0."""
        m = self.df.agg(F.avg("x").alias("_m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("_s"))
        return Vector(self.df.crossJoin(F.broadcast(m)).select("idx", F.when(F.col("_s") > 0, (F.col("x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).otherwise(F.col("x")).alias("x")), self._size)

    def softmax(self) -> Vector:
        top = self.df.agg(F.max("x").alias("_t"))
        e = self.df.crossJoin(F.broadcast(top)).select("idx", F.exp(F.col("x") - F.col("_t")).alias("x"))
        s = e.agg(F.sum("x").alias("_s"))
        return Vector(e.crossJoin(F.broadcast(s)).select("idx", (F.col("x") / F.col("_s")).alias("x")), self._size)

    # Masks and filters
    def _mask(self, test: Column) -> list[bool]:
        """A Python list of at most MOST_COLLECTED; gt_mask and the like give Vectors of any length."""
        self._bounded()
        return [r.x for r in self.df.select("idx", test.alias("x")).orderBy("idx").collect()]

    def __eq__(self, other):
        if isinstance(other, Vector):
            self._bounded()
            return [r.r for r in self._zip(other).select("idx", ieee.compare(F.col("x"), "eq", F.col("y")).alias("r")).orderBy("idx").collect()]
        return self._mask(ieee.compare(F.col("x"), "eq", float(other)))

    __hash__ = None

    def _compared(self, op: str, other):
        return self._mask(ieee.compare(F.col("x"), op, float(other)))

    def __lt__(self, o):
        return self._compared("lt", o)

    def __le__(self, o):
        return self._compared("le", o)

    def __gt__(self, o):
        return self._compared("gt", o)

    def __ge__(self, o):
        return self._compared("ge", o)

    def __ne__(self, o):
        return self._compared("ne", o)

    def isnan(self):
        return self._mask(F.isnan("x"))

    def isfinite(self):
        return self._mask(ieee.isfinite(F.col("x")))

    def isinf(self):
        return self._mask(ieee.isinf(F.col("x")))

    def is_integer(self):
        return self._mask(ieee.is_integer(F.col("x")))

    def is_prime(self):
        return self._mask(ieee.is_prime(F.col("x")))

    def _number_mask(self, op: str, t: float) -> Vector:
        return self._map(F.when(ieee.compare(F.col("x"), op, float(t)), 1.0).otherwise(0.0))

    def gt_mask(self, t: float) -> Vector:
        return self._number_mask("gt", t)

    def lt_mask(self, t: float) -> Vector:
        return self._number_mask("lt", t)

    def eq_mask(self, t: float) -> Vector:
        return self._number_mask("eq", t)

    def _kept(self, df: DataFrame) -> Vector:
        return Vector(ordered.reindex(df.withColumnRenamed("idx", "_i"), "_i"))

    def filter_gt(self, t: float) -> Vector:
        return self._kept(self.df.filter(ieee.compare(F.col("x"), "gt", float(t))))

    def filter_lt(self, t: float) -> Vector:
        return self._kept(self.df.filter(ieee.compare(F.col("x"), "lt", float(t))))

    def filter_finite(self) -> Vector:
        return self._kept(self.df.filter(ieee.isfinite(F.col("x"))))

    def filter_by_mask(self, mask) -> Vector:
        mask = mask if isinstance(mask, Vector) else Vector(mask)
        return self._kept(self._zip(mask).filter("y <> 0").select("idx", "x"))

    def filter_by_masks(self, masks) -> Vector:
        out = self.df
        for m in masks:
            out = out.join(m.df.filter("x <> 0").select("idx"), "idx", "left_semi")
        return self._kept(out) if masks else self

    def filter_where(self, conditions, mode: str = "all") -> Vector:
        return self.multi_filter_where([self], conditions, mode)[0]

    @staticmethod
    def multi_filter_where(vectors, conditions, mode: str = "all") -> list[Vector]:
        """vectors filtered together by [(vector, op, threshold)]."""
        table = vectors[0].df.withColumnRenamed("x", "v0")
        for i, v in enumerate(vectors[1:], 1):
            table = table.join(v.df.withColumnRenamed("x", f"v{i}"), "idx")
        for i, (v, _, _) in enumerate(conditions):
            table = table.join(v.df.withColumnRenamed("x", f"c{i}"), "idx")
        kept = table.filter(ieee.predicate([(f"c{i}", op, float(t)) for i, (_, op, t) in enumerate(conditions)], mode))
        kept = ordered.reindex(kept.withColumnRenamed("idx", "_i"), "_i")
        return [Vector(kept.select("idx", F.col(f"v{i}").alias("x"))) for i in range(len(vectors))]

    def where_(self, mask, other: Vector) -> Vector:
        m = mask if isinstance(mask, Vector) else Vector(mask)
        return Vector(self._zip(other).join(m.df.withColumnRenamed("x", "m"), "idx").select("idx", F.when(F.col("m") != 0, F.col("x")).otherwise(F.col("y")).alias("x")), self._size)

    # Order, runs and shape
    def sort(self) -> Vector:
        return Vector(ordered.with_index(self.df.select("x"), "x"), self._size)

    def sort_desc(self) -> Vector:
        return Vector(ordered.with_index(self.df.select("x"), F.desc("x")), self._size)

    def argsort(self) -> list[int]:
        self._bounded()
        return [r.idx for r in self.df.orderBy("x", "idx").select("idx").collect()]

    def reverse(self) -> Vector:
        return Vector(self.df.select((len(self) - 1 - F.col("idx")).alias("idx"), "x"), self._size)

    def unique(self) -> Vector:
        return Vector(ordered.reindex(reduce.unique(self.df, "x", "idx"), "first"))

    def cumsum(self) -> Vector:
        return Vector(ordered.cumsum(self.df), self._size)

    def cumprod(self) -> Vector:
        return Vector(ordered.cumprod(self.df), self._size)

    def diff(self) -> Vector:
        return Vector(ordered.diff(self.df))

    def head(self, n: int) -> Vector:
        return Vector(self.df.filter(F.col("idx") < n))

    def tail(self, n: int) -> Vector:
        return self[max(0, len(self) - n) :]

    def chunks(self, size: int) -> DataFrame:
        """(chunk, values): consecutive pieces of `size`."""
        if size <= 0:
            raise ValueError("chunk size must be positive")
        pairs = self.df.groupBy(F.floor(F.col("idx") / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("v"))
        return pairs.select("chunk", F.col("v.x").alias("values"))

    def append(self, value: float) -> Vector:
        return self.extend([value])

    def extend(self, other) -> Vector:
        o = other if isinstance(other, Vector) else Vector(other)
        return Vector(self.df.unionByName(o.df.select((F.col("idx") + len(self)).alias("idx"), "x")), len(self) + len(o))


def _elementwise(f):
    return lambda self: self._map(f(F.col("x")))


def _reduction(f):
    return lambda self: self._one(f(F.col("x")))


for _name, _f in ieee.ELEMENTWISE.items():
    if not hasattr(Vector, _name):
        setattr(Vector, _name, _elementwise(_f))
for _name, _f in {"sum": reduce.total, "prod": reduce.prod, "mean": reduce.mean, "min": reduce.least, "max": reduce.most, "variance": reduce.variance, "pop_variance": reduce.pop_variance, "std_dev": reduce.std_dev, "pop_std_dev": reduce.pop_std_dev, "norm": reduce.norm, "norm_l1": reduce.norm_l1, "norm_inf": reduce.norm_inf, "any": reduce.any_, "all": reduce.all_}.items():
    setattr(Vector, _name, _reduction(_f))
Vector.vsum, Vector.vmin, Vector.vmax = Vector.sum, Vector.min, Vector.max
