"""LazyPipeline: maps and filters of one column that Catalyst fuses; terminals run it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.operators import ordered, reduce
from tessera.operators.vector import Vector


class LazyPipeline:
    def __init__(self, source: Vector, df=None, steps: int = 0):
        self.source, self.df, self.steps = source, source.df if df is None else df, steps

    def _map(self, x: Column) -> LazyPipeline:
        return LazyPipeline(self.source, self.df.select("idx", x.alias("x")), self.steps + 1)

    def _filter(self, test: Column) -> LazyPipeline:
        return LazyPipeline(self.source, self.df.filter(test), self.steps + 1)

    def add(self, v: float) -> LazyPipeline:
        return self._map(F.col("x") + float(v))

    def sub(self, v: float) -> LazyPipeline:
        return self._map(F.col("x") - float(v))

    def mul(self, v: float) -> LazyPipeline:
        return self._map(F.col("x") * float(v))

    def div(self, v: float) -> LazyPipeline:
        if v == 0:
            raise ZeroDivisionError("division by zero")
        return self._map(F.col("x") / float(v))

    def filter_gt(self, v: float) -> LazyPipeline:
        """Keeps NaN, unlike Vector.filter_gt."""
        return self._filter((F.col("x") > float(v)) | F.isnan("x"))

    def filter_lt(self, v: float) -> LazyPipeline:
        return self._filter((F.col("x") < float(v)) | F.isnan("x"))

    def filter_finite(self) -> LazyPipeline:
        return self._filter(ieee.isfinite(F.col("x")))

    def as_(self, target: str) -> LazyPipeline:
        return self

    def _one(self, c: Column) -> float:
        return self.df.agg(c.alias("r")).first().r

    def sum(self) -> float:
        return self._one(reduce.total(F.col("x")))

    def mean(self) -> float:
        return self._one(reduce.mean(F.col("x")))

    def var(self) -> float:
        """The population variance."""
        return self._one(reduce.pop_variance(F.col("x")))

    def std(self) -> float:
        return math.sqrt(self.var())

    def max(self) -> float:
        return self._one(F.coalesce(F.max(F.when(~F.isnan("x"), F.col("x"))), F.lit(-math.inf if len(self.source) else math.nan)))

    def min(self) -> float:
        return self._one(F.coalesce(F.min(F.when(~F.isnan("x"), F.col("x"))), F.lit(math.inf if len(self.source) else math.nan)))

    def to_vector(self) -> Vector:
        return Vector(ordered.reindex(self.df.withColumnRenamed("idx", "_i"), "_i"))

    def to_tuple(self) -> tuple[float, ...]:
        self.source._bounded()
        return tuple(r.x for r in self.df.orderBy("idx").collect())

    def __len__(self) -> int:
        return len(self.source)

    def __repr__(self) -> str:
        return f"LazyPipeline({len(self.source)} elements, {self.steps} steps)"


for _n in ("sin", "cos", "sqrt", "abs", "exp"):
    setattr(LazyPipeline, _n, (lambda f: lambda self: self._map(f(F.col("x"))))(ieee.ELEMENTWISE[_n]))


def loop_range(start: float, stop: float | None = None, step: float = 1.0) -> LazyPipeline:
    a, b = (0.0, start) if stop is None else (start, stop)
    if step == 0 or (b - a) * step < 0:
        raise ValueError("step does not lead from start to stop")
    return LazyPipeline(Vector.arange(a, b, step))


def from_list(data) -> LazyPipeline:
    return LazyPipeline(Vector(data))


def zeros(n: int) -> LazyPipeline:
    return LazyPipeline(Vector.zeros(n))


def linspace(start: float, stop: float, n: int) -> LazyPipeline:
    if n <= 0:
        raise ValueError("n must be positive")
    return LazyPipeline(Vector.linspace(start, stop, n))
