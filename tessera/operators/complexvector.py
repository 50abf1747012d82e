"""ComplexVector: an ordered column of complex numbers, as a lazy DataFrame (idx, re, im)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import signal
from tessera.operators.vector import Vector, _spark


class ComplexVector:
    def __init__(self, real, imag=None, size: int | None = None):
        """From two lists or Vectors of one length, or from a DataFrame (idx, re, im)."""
        if isinstance(real, DataFrame):
            self.df, self._size = real.select("idx", "re", "im"), size
        elif isinstance(real, Vector):
            self.df, self._size = real._zip(imag).select("idx", F.col("x").alias("re"), F.col("y").alias("im")), len(real)
        else:
            rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(real, imag, strict=True))]
            self.df, self._size = _spark().createDataFrame(rows, "idx long, re double, im double"), len(rows)

    def __len__(self) -> int:
        if self._size is None:
            self._size = self.df.count()
        return self._size

    def to_mags(self) -> Vector:
        return Vector(self.df.select("idx", F.hypot("re", "im").alias("x")), self._size)

    def to_phases(self) -> Vector:
        return Vector(self.df.select("idx", F.atan2("im", "re").alias("x")), self._size)

    def mask_inplace(self, mask) -> None:
        """Zero where mask (booleans, or a Vector that is 0 there) is false."""
        flags = (mask if isinstance(mask, Vector) else Vector(map(float, mask))).df.select("idx", F.col("x").alias("_keep"))
        if len(self) != flags.count():
            raise ValueError("lengths do not match")
        self.df = signal.mask(self.df.join(flags, "idx"), F.col("_keep") != 0).drop("_keep")

    def to_list(self) -> list[complex]:
        self.to_mags()._bounded()
        return [complex(r.re, r.im) for r in self.df.orderBy("idx").collect()]

    def __repr__(self) -> str:
        return f"ComplexVector({len(self)} values)"
