"""Array: a matrix (or a stack of them) as a lazy DataFrame of rows (row_id, v array<double>).

The last dimension lies in v; all leading ones are flattened into row_id in row-major order, and the shape is metadata.
Tall matrices stay distributed: Gram matrices, covariances, column statistics and products with a small right side are
one pass.  Factorisations of general matrices run on the driver for at most MOST_DENSE elements.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ieee, nn
from tessera.operators import geometry, ordered, reduce
from tessera.operators.store import stored
from tessera.operators.vector import MOST_COLLECTED, Vector, _spark

MOST_DENSE = 16_000_000
#: Rows of a block, and triangles of a step at most, of the factorisation of a tall matrix.
TALL_ROWS, TALL_FAN = 4096, 16


def _constant(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


class Array:
    def __init__(self, data, shape: list[int] | None = None, dtype: str = "float64"):
        if dtype not in ("float64", "float32", "float16"):
            raise ValueError(f"unknown dtype {dtype!r}")
        self.dtype = dtype
        if isinstance(data, DataFrame):
            v = F.col("v").cast("array<double>")
            self.df, self._shape = data.select(F.col("row_id").cast("long").alias("row_id"), (v if dtype == "float64" else F.transform(v, lambda x: ieee.rounded_to(x, dtype))).alias("v")), list(shape) if shape else None
            return
        try:
            a = np.array(data, float).astype(dtype).astype(float)
        except ValueError as e:
            raise ValueError("ragged rows") from e
        a = a if shape is None else a.reshape(shape)
        a = a.reshape(0, 0) if a.size == 0 and a.ndim < 2 else a.reshape(1, -1) if a.ndim == 1 else a
        rows = a.reshape(-1, a.shape[-1]) if a.size else a.reshape(a.shape[0], -1)
        self.df = _spark().createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "row_id bigint, v array<double>")
        self._shape = list(a.shape)

    # Constructors
    @classmethod
    def from_list(cls, data, shape) -> Array:
        if math.prod(shape) != len(data):
            raise ValueError("shape does not fit the data")
        return cls(data, shape)

    @classmethod
    def from_table(cls, df: DataFrame, columns, *order) -> Array:
        return cls(ordered.with_index(df, *order, name="row_id").select("row_id", F.array(*columns).alias("v")))

    @classmethod
    def full(cls, *args) -> Array:
        *shape, value = args
        shape = list(shape[0]) if shape and isinstance(shape[0], (list, tuple)) else list(shape)
        return cls._rows(shape, F.array_repeat(F.lit(float(value)), shape[-1]))

    @classmethod
    def _rows(cls, shape, v: Column) -> Array:
        return cls(_spark().range(math.prod(shape[:-1])).select(F.col("id").alias("row_id"), v.alias("v")), shape)

    @classmethod
    def zeros(cls, *shape) -> Array:
        return cls.full(*(shape[0] if isinstance(shape[0], (list, tuple)) else shape), 0.0)

    @classmethod
    def ones(cls, *shape) -> Array:
        return cls.full(*(shape[0] if isinstance(shape[0], (list, tuple)) else shape), 1.0)

    zeros_nd, ones_nd = zeros, ones

    @classmethod
    def eye(cls, n: int) -> Array:
        return cls._rows([n, n], F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(j == F.col("id"), 1.0).otherwise(0.0)))

    @classmethod
    def _random(cls, shape, draw: str, scale: float = 1.0, shift: float = 0.0, seed: int | None = None) -> Array:
        n = shape[-1]
        cells = [(getattr(F, draw)(None if seed is None else seed + j) * scale + shift) for j in range(n)]
        return cls._rows(list(shape), F.array(*cells))

    @classmethod
    def randn(cls, *shape, seed: int | None = None) -> Array:
        return cls._random(shape[0] if isinstance(shape[0], (list, tuple)) else shape, "randn", seed=seed)

    @classmethod
    def rand_uniform(cls, *shape, seed: int | None = None) -> Array:
        return cls._random(shape[0] if isinstance(shape[0], (list, tuple)) else shape, "rand", seed=seed)

    @classmethod
    def glorot(cls, shape, uniform: bool = True, seed: int | None = None) -> Array:
        fan = (shape[1] if len(shape) > 1 else shape[0]) + shape[0]
        return cls._random(shape, "rand", 2 * math.sqrt(6 / fan), -math.sqrt(6 / fan), seed) if uniform else cls._random(shape, "randn", math.sqrt(2 / fan), 0.0, seed)

    @classmethod
    def he(cls, shape, uniform: bool = True, seed: int | None = None) -> Array:
        fan = shape[1] if len(shape) > 1 else shape[0]
        return cls._random(shape, "rand", 2 * math.sqrt(6 / fan), -math.sqrt(6 / fan), seed) if uniform else cls._random(shape, "randn", math.sqrt(2 / fan), 0.0, seed)

    @classmethod
    def arange(cls, start: float, stop: float, step: float = 1.0) -> Array:
        return cls([np.arange(start, stop, step)])

    range = arange

    @classmethod
    def linspace(cls, start: float, stop: float, n: int) -> Array:
        return cls([np.linspace(start, stop, n)])

    @classmethod
    def from_numpy(cls, a) -> Array:
        return cls(np.asarray(a, float))

    @classmethod
    def from_dataframe(cls, pdf: pd.DataFrame) -> Array:
        return cls(pdf.to_numpy(float))

    from_torch = from_jax = from_numpy

    # Shape
    @property
    def shape(self) -> list[int]:
        if self._shape is None:
            r = self.df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("m")).first()
            self._shape = [r.n, r.m or 0]
        return self._shape

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def nrows(self) -> int:
        return self.shape[0]

    @property
    def ncols(self) -> int:
        return self.shape[1] if self.ndim > 1 else self.shape[0]

    def __len__(self) -> int:
        return self.nrows

    def sklearn_shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    def estimated_bytes(self) -> int:
        return 7 + 8 * self.ndim + 8 * self.size

    def memory_bytes(self) -> int:
        return 8 * self.size

    def cells(self) -> DataFrame:
        """(i, j, x), one row an element."""
        return self.df.select(F.col("row_id").alias("i"), F.posexplode("v").alias("j", "x"))

    @classmethod
    def from_cells(cls, cells: DataFrame, shape) -> Array:
        rows = cells.groupBy(F.col("i").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s.x).alias("v"))
        return cls(rows, shape)

    def reshape(self, *shape) -> Array:
        shape = list(shape[0]) if isinstance(shape[0], (list, tuple)) else list(shape)
        if math.prod(shape) != self.size:
            raise ValueError("shapes hold different counts")
        if shape[-1] == self.shape[-1]:
            return Array(self.df, shape)
        flat = F.col("i") * self.shape[-1] + F.col("j")
        return Array.from_cells(self.cells().select(F.floor(flat / shape[-1]).alias("i"), (flat % shape[-1]).alias("j"), "x"), shape)

    def flatten(self) -> Array:
        return self.reshape([1, self.size])

    def squeeze(self) -> Array:
        return self.reshape([d for d in self.shape if d != 1] or [1])

    def expand_dims(self, axis: int) -> Array:
        return self.reshape([*self.shape[:axis], 1, *self.shape[axis:]])

    def slice_rows(self, start: int, end: int) -> Array:
        per = math.prod(self.shape[1:-1])
        i = F.col("row_id")
        return Array(self.df.filter((i >= start * per) & (i < end * per)).select((i - start * per).alias("row_id"), "v"), [max(0, min(end, self.nrows) - start), *self.shape[1:]])

    def get_row(self, i: int) -> list[float]:
        return list(self.df.filter(F.col("row_id") == i).first().v)

    def get_col(self, j: int) -> list[float]:
        self._bounded(self.size // self.shape[-1])
        return [r.x for r in self.df.orderBy("row_id").select(F.get("v", F.lit(j)).alias("x")).collect()]

    def __getitem__(self, key):
        key = key if isinstance(key, tuple) else (key,)
        spans = [range(*k.indices(d)) if isinstance(k, slice) else range(k % d, k % d + 1) for k, d in zip((*key, *[slice(None)] * (self.ndim - len(key))), self.shape, strict=True)]
        if all(isinstance(k, int) for k in key) and len(key) == self.ndim:
            row = 0
            for k, d in zip(spans[:-1], self.shape[:-1], strict=True):
                row = row * d + k.start
            return self.get_row(row)[spans[-1].start]
        rest, test, new = F.col("row_id"), F.lit(True), F.lit(0).cast("long")
        place = []
        for d in reversed(self.shape[:-1]):
            place.insert(0, rest % d)
            rest = F.floor(rest / d)
        for p, s in zip(place, spans[:-1], strict=True):
            test = test & (p >= s.start) & (p < s.stop) & ((p - s.start) % s.step == 0)
            new = new * len(s) + F.floor((p - s.start) / s.step)
        last = spans[-1]
        v = F.transform(F.sequence(F.lit(last.start), F.lit(last[-1]), F.lit(last.step)), lambda j: F.get("v", j))
        return Array(self.df.filter(test).select(new.alias("row_id"), v.alias("v")), [len(s) for s in spans])

    def __setitem__(self, key, value: float) -> None:
        row = 0
        for k, d in zip(key[:-1], self.shape[:-1], strict=True):
            row = row * d + k
        self.df = self.df.withColumn("v", F.when(F.col("row_id") == row, F.transform("v", lambda x, j: F.when(j == key[-1], float(value)).otherwise(x))).otherwise(F.col("v")))

    # Conversion
    def to_numpy(self) -> np.ndarray:
        self._bounded(self.size)
        rows = [r.v for r in self.df.orderBy("row_id").collect()]
        return np.array(rows, float).reshape(self.shape)

    def __array__(self, dtype=None, copy=None):
        return self.to_numpy().astype(dtype or float)

    def to_list(self):
        return self.to_numpy().tolist()

    tolist = to_list

    def to_flat_list(self) -> list[float]:
        return self.to_numpy().ravel().tolist()

    to_flat_py = to_flat_list

    def into_vector(self) -> Vector:
        n = self.shape[-1]
        return Vector(self.cells().select((F.col("i") * n + F.col("j")).alias("idx"), "x"), self.size)

    def to_dataframe(self, columns=None) -> pd.DataFrame:
        return pd.DataFrame(self.to_numpy(), columns=columns)

    def to_series(self, name=None) -> pd.Series:
        return pd.Series(self.to_flat_list(), name=name)

    def to_torch(self):
        import torch

        return torch.from_numpy(self.to_numpy())

    def to_jax(self):
        import jax

        return jax.numpy.asarray(self.to_numpy())

    def __dlpack__(self, stream=None):
        return self.to_numpy().__dlpack__()

    def __dlpack_device__(self):
        return (1, 0)

    def validate_sklearn(self) -> None:
        if self.ndim != 2 or not self.df.filter(F.exists("v", lambda x: ~ieee.isfinite(x))).isEmpty():
            raise ValueError("not a finite matrix")

    def copy(self) -> Array:
        return Array(self.df, self._shape, self.dtype)

    def astype(self, dtype: str) -> Array:
        """The values rounded to what dtype holds; they are computed with as doubles."""
        return Array(self.df, self._shape, dtype)

    #: Every Array is a plan: nothing runs before a result is asked for.
    lazy = copy

    # Files (see tessera.sources.files)
    def save(self, path: str) -> None:
        from tessera.sources import files

        files.save(self, path)

    def save_bin(self, path: str) -> None:
        from tessera.sources import files

        files.save_bin(self, path)

    def save_csv(self, path: str, header=None) -> None:
        from tessera.sources import files

        files.write_csv(self, path, header)

    def save_safetensors(self, path: str, key: str) -> None:
        from tessera.sources import files

        files.save_safetensors(self, path, key)

    @staticmethod
    def load(path: str) -> Array:
        from tessera.sources import files

        return files.load(_spark(), path)

    @staticmethod
    def load_csv(path: str) -> Array:
        from tessera.sources import files

        return files.read_csv(_spark(), path)[0]

    @staticmethod
    def load_csv_with_header(path: str) -> tuple[Array, list[str]]:
        from tessera.sources import files

        return files.read_csv(_spark(), path, header=True)

    @staticmethod
    def load_safetensors(path: str, key: str) -> Array:
        from tessera.sources import files

        return files.load_safetensors(_spark(), path, key)

    def __repr__(self) -> str:
        return f"Array(shape={self.shape}, first rows={[list(r.v)[:6] for r in self.df.orderBy('row_id').limit(3).collect()]})"

    # Elementwise
    def _map(self, f) -> Array:
        return Array(self.df.select("row_id", F.transform("v", f).alias("v")), self._shape)

    def _with(self, other, f) -> Array:
        """Broadcasting: numbers, vectors (one number a column), arrays of equal, one-row or one-column shape."""
        if isinstance(other, Vector):
            other = Array([other.to_list()])
        if not isinstance(other, Array):
            return self._map(lambda x: f(x, F.lit(float(other))))
        a, b = self.shape, other.shape
        if len(a) == 2 and len(b) == 2 and a != b:
            rows, cols = max(a[0], b[0]), max(a[1], b[1])
            if any(x not in (1, y) for s in (a, b) for x, y in zip(s, (rows, cols), strict=True)):
                raise ValueError("shapes do not match")
            left, right = self._stretched(cols), other._stretched(cols)
            one = F.lit(0).cast("long")
            on = (one if a[0] == 1 else F.col("row_id")) == (one if b[0] == 1 else F.col("_r"))
            r = right.select(F.col("row_id").alias("_r"), F.col("v").alias("_v"))
            joined = left.crossJoin(F.broadcast(r)) if b[0] == 1 else r.crossJoin(F.broadcast(left)) if a[0] == 1 else left.join(r, on)
            return Array(joined.select((F.col("_r") if a[0] == 1 else F.col("row_id")).alias("row_id"), F.zip_with("v", "_v", f).alias("v")), [rows, cols])
        if a != b:
            raise ValueError("shapes do not match")
        joined = self.df.join(other.df.withColumnRenamed("v", "_v"), "row_id")
        return Array(joined.select("row_id", F.zip_with("v", "_v", f).alias("v")), a)

    def _stretched(self, cols: int) -> DataFrame:
        return self.df.withColumn("v", F.array_repeat(F.get("v", F.lit(0)), cols)) if self.shape[1] == 1 != cols else self.df

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._map(lambda x: float(o) - x)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        if not isinstance(o, (Array, Vector)) and float(o) == 0:
            raise ZeroDivisionError("division by zero")
        return self._with(o, ieee.div)

    def __rtruediv__(self, o):
        return self._map(lambda x: ieee.div(float(o), x))

    def __pow__(self, o):
        return self._with(o, F.pow)

    def __neg__(self):
        return self._map(lambda x: -x)

    def __pos__(self):
        return self

    def __abs__(self):
        return self._map(F.abs)

    __radd__, __rmul__ = __add__, __mul__
    add = add_array = __iadd__ = __add__
    sub = sub_array = __isub__ = __sub__
    mul = mul_array_elementwise = __imul__ = __mul__
    div = div_array_elementwise = __itruediv__ = __truediv__
    pow = pow_scalar = __pow__

    def signum(self) -> Array:
        return self._map(lambda x: F.when(F.isnan(x), x).when(x >= 0, 1.0).otherwise(-1.0))

    def clamp(self, lo: float, hi: float) -> Array:
        return self._map(lambda x: ieee.clamp(x, lo, hi))

    def hypot_scalar(self, o: float) -> Array:
        return self._map(lambda x: F.hypot(x, F.lit(float(o))))

    def atan2_scalar(self, o: float) -> Array:
        return self._map(lambda x: F.atan2(x, F.lit(float(o))))

    def lerp_scalar(self, o: float, t: float) -> Array:
        return self._map(lambda x: x + t * (o - x))

    def fma(self, m: float, a: float) -> Array:
        return self._map(lambda x: x * m + a)

    def normalize(self, mean, std) -> Array:
        return (self - mean) / std

    def _bounded(self, n: int) -> None:
        if n > MOST_COLLECTED:
            raise MemoryError(f"{n} elements; collecting is limited to {MOST_COLLECTED}")

    def _flat_mask(self, f) -> list[bool]:
        self._bounded(self.size)
        return [x for r in self.df.orderBy("row_id").select(F.transform("v", f).alias("m")).collect() for x in r.m]

    def gt(self, t):
        return self._flat_mask(lambda x: ieee.compare(x, "gt", t))

    def lt(self, t):
        return self._flat_mask(lambda x: ieee.compare(x, "lt", t))

    def ge(self, t):
        return self._flat_mask(lambda x: ieee.compare(x, "ge", t))

    def le(self, t):
        return self._flat_mask(lambda x: ieee.compare(x, "le", t))

    def eq_scalar(self, t):
        return self._flat_mask(lambda x: ieee.compare(x, "eq", t))

    def ne_scalar(self, t):
        return self._flat_mask(lambda x: ieee.compare(x, "ne", t))

    def isnan(self):
        return self._flat_mask(F.isnan)

    def isfinite(self):
        return self._flat_mask(ieee.isfinite)

    def isinf(self):
        return self._flat_mask(ieee.isinf)

    def is_prime(self):
        return self._flat_mask(ieee.is_prime)

    def where_scalar(self, mask, other: float) -> Array:
        return self._with(Array.from_list([float(m) for m in mask], self.shape), lambda x, m: F.when(m != 0, x).otherwise(float(other)))

    # Reductions
    def _cells_agg(self, c: Column):
        return self.cells().agg(c.alias("r")).first().r

    def sum_all(self) -> float:
        return self.df.agg(F.coalesce(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)), F.lit(0.0)).alias("r")).first().r

    def prod(self) -> float:
        return self._cells_agg(reduce.prod(F.col("x")))

    def mean(self) -> float:
        return self._cells_agg(reduce.mean(F.col("x")))

    def variance(self) -> float:
        return self._cells_agg(reduce.variance(F.col("x")))

    def std_dev(self) -> float:
        return self._cells_agg(reduce.std_dev(F.col("x")))

    def min(self) -> float:
        return self._cells_agg(F.coalesce(F.min("x"), F.lit(math.inf)))

    def max(self) -> float:
        return self._cells_agg(F.coalesce(F.max("x"), F.lit(-math.inf)))

    def argmin(self) -> int:
        return max(0, self._cells_agg(reduce.argmin(F.col("x"), F.col("i") * self.shape[-1] + F.col("j"))))

    def argmax(self) -> int:
        return max(0, self._cells_agg(reduce.argmax(F.col("x"), F.col("i") * self.shape[-1] + F.col("j"))))

    def norm_frobenius(self) -> float:
        return self._cells_agg(reduce.norm(F.col("x")))

    def trace(self) -> float:
        return self.df.agg(F.sum(F.get("v", F.col("row_id").cast("int"))).alias("r")).first().r

    def _by_column(self, f) -> Vector:
        if not self.nrows:
            raise ValueError("empty matrix")
        return Vector(self.cells().groupBy(F.col("j").alias("idx")).agg(f(F.col("x")).alias("x")), self.ncols)

    def _by_row(self, f) -> Vector:
        return Vector(self.df.select(F.col("row_id").alias("idx"), f("v").alias("x")), self.nrows)

    def sum(self, axis: int | None = None):
        if axis is None:
            return self.sum_all()
        return self._by_column(F.sum) if axis == 0 else self._by_row(lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x))

    def mean_axis0(self) -> Vector:
        return self._by_column(F.avg)

    def mean_axis1(self) -> Vector:
        return self._by_row(lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))

    def var_axis0(self) -> Vector:
        if self.nrows < 2:
            raise ValueError("two rows are needed")
        return self._by_column(F.var_samp)

    def std_axis0(self) -> Vector:
        if self.nrows < 2:
            raise ValueError("two rows are needed")
        return self._by_column(lambda x: F.stddev_samp(x) + 1e-8)

    # Products
    def transpose(self) -> Array:
        *lead, r, c = self.shape
        swapped = self.cells().select((F.floor(F.col("i") / r) * c + F.col("j")).alias("i"), (F.col("i") % r).alias("j"), "x")
        return Array.from_cells(swapped, [*lead, c, r])

    t = transpose

    def matmul(self, other):
        """A B or A v.  A right side of at most MOST_DENSE elements goes to every task and a product is a projection;
        larger ones are joined and summed by cell."""
        if isinstance(other, Vector):
            w = _constant(other.to_list())
            return Vector(self.df.select(F.col("row_id").alias("idx"), F.aggregate(F.zip_with("v", w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("x")), self.nrows)
        *lead, r, k = self.shape
        *lead_b, kb, c = other.shape
        if k != kb or (lead_b and lead != lead_b):
            raise ValueError("shapes do not match")
        if not lead_b and kb * c <= MOST_DENSE:
            shared = self.df.sparkSession.sparkContext.broadcast(other.to_numpy())

            def product(batches):
                for pdf in batches:
                    pdf["v"] = list(np.array(pdf["v"].tolist(), float).reshape(len(pdf), k) @ shared.value)
                    yield pdf

            return Array(self.df.mapInPandas(product, "row_id long, v array<double>"), [*lead, r, c])
        left = self.cells().select(F.col("i"), F.floor(F.col("i") / r).alias("g"), F.col("j").cast("long").alias("k"), "x")
        right = other.cells().select(F.floor(F.col("i") / kb).alias("g"), (F.col("i") % kb).alias("k"), "j", F.col("x").alias("y"))
        cells = left.join(right, ["g", "k"]).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("x"))
        return Array.from_cells(cells, [*lead, r, c])

    __matmul__ = matmul

    def matmul_trans(self, v: Vector) -> Vector:
        joined = self.df.join(v.df.withColumnRenamed("idx", "row_id"), "row_id").select("x", F.posexplode("v").alias("idx", "y"))
        return Vector(joined.groupBy("idx").agg(F.sum(F.col("x") * F.col("y")).alias("x")), self.ncols)

    def _moments(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(rows, column sums, A^T A): each task sums its rows' outer products; the driver adds one matrix a task."""
        m = self.ncols
        if m * m > MOST_DENSE:
            raise ValueError(f"a Gram matrix of more than {MOST_DENSE} elements")

        def local(batches):
            n, s, g = 0, np.zeros(m), np.zeros((m, m))
            for pdf in batches:
                a = np.array(pdf["v"].tolist(), float).reshape(len(pdf), m)
                n, s, g = n + len(a), s + a.sum(0), g + a.T @ a
            yield pd.DataFrame({"k": [-2, -1, *range(m)], "v": [[float(n)], s.tolist(), *g.tolist()]})

        parts = self.df.mapInPandas(local, "k int, v array<double>").select("k", F.posexplode("v").alias("j", "x")).groupBy("k", "j").agg(F.sum("x").alias("x")).collect()
        n, s, g = 0, np.zeros(m), np.zeros((m, m))
        for r in parts:
            if r.k == -2:
                n = int(r.x)
            elif r.k == -1:
                s[r.j] = r.x
            else:
                g[r.k, r.j] = r.x
        return n, s, g

    def _row_moments(self, width: int = 4096) -> tuple[int, np.ndarray, np.ndarray]:
        """(columns, row sums, A A^T) of a matrix of few rows, from blocks of `width` columns; no row is turned into one."""
        n = self.nrows
        if n * n > MOST_DENSE:
            raise ValueError(f"a matrix of rows of more than {MOST_DENSE} elements")

        def local(pdf):
            a = np.zeros((n, width))
            a[pdf["i"].to_numpy(), pdf["j"].to_numpy() % width] = pdf["x"].to_numpy()
            return pd.DataFrame({"k": [-1, *range(n)], "v": [a.sum(1).tolist(), *(a @ a.T).tolist()]})

        parts = self.cells().groupBy(F.floor(F.col("j") / width).alias("b")).applyInPandas(local, "k int, v array<double>")
        s, g = np.zeros(n), np.zeros((n, n))
        for r in parts.select("k", F.posexplode("v").alias("j", "x")).groupBy("k", "j").agg(F.sum("x").alias("x")).collect():
            if r.k == -1:
                s[r.j] = r.x
            else:
                g[r.k, r.j] = r.x
        return self.ncols, s, g

    def gram_matrix(self) -> Array:
        return Array(self._moments()[2])

    def covariance(self) -> Array:
        """Of the columns, over rows - 1."""
        n, s, g = self._moments()
        return Array((g - np.outer(s, s) / n) / (n - 1))

    def correlation_matrix(self) -> Array:
        """Of the rows; 0 where a row is constant, 1 on the diagonal."""
        n, s, g = self._row_moments()
        c = g / n - np.outer(s / n, s / n)
        d = np.sqrt(np.outer(np.diag(c), np.diag(c)))
        r = np.where(d > 0, c / np.where(d > 0, d, 1), 0.0)
        np.fill_diagonal(r, 1.0)
        return Array(r)

    def cdist(self, other: Array) -> Array:
        pairs = geometry.cdist(self.df.withColumnRenamed("row_id", "id"), other.df.withColumnRenamed("row_id", "id"))
        return Array.from_cells(pairs.withColumnRenamed("d", "x"), [self.nrows, other.nrows])

    def distance(self, query):
        if isinstance(query, Array):
            return self.cdist(query)
        q = _constant(query.to_list())
        return Vector(self.df.select(F.col("row_id").alias("idx"), geometry.euclidean("v", q).alias("x")), self.nrows)

    # Factorisations
    def _dense(self, square: bool = False) -> np.ndarray:
        if self.size > MOST_DENSE:
            raise ValueError(f"more than {MOST_DENSE} elements; use the Gram matrix of a tall matrix")
        if square and self.shape[-1] != self.shape[-2]:
            raise ValueError("not square")
        return self.to_numpy()

    def inv(self) -> Array:
        try:
            return Array(np.linalg.inv(self._dense(True)))
        except np.linalg.LinAlgError as e:
            raise ValueError("singular matrix") from e

    def solve(self, b: Array) -> Array:
        try:
            return Array(np.linalg.solve(self._dense(True), b.to_numpy()))
        except np.linalg.LinAlgError as e:
            raise ValueError("singular matrix") from e

    def det(self) -> float:
        return float(np.linalg.det(self._dense(True)))

    def rank(self) -> int:
        s = np.linalg.svd(self._tall_qr()[1] if self._is_tall() else self._dense(), compute_uv=False)
        return int((s > 1e-10 * max(s[0], 1)).sum()) if len(s) else 0

    def _tall_qr(self) -> tuple[DataFrame, np.ndarray]:
        """((row_id, v): rows of Q, R) of a matrix with no more columns than rows, none of which is collected.

        Rows are taken in blocks of TALL_ROWS; each is factorised in one task, their triangles are stacked and factorised
        again TALL_FAN at a time until one is left, and Q is what the levels multiply to (tall-skinny QR).  Nothing is squared, so
        small and zero singular values stay right.
        """
        m = self.ncols
        fan = max(2, min(TALL_FAN, MOST_DENSE // (m * m)))

        def factor(pdf):
            pdf = pdf.sort_values("row_id")
            q, r = np.linalg.qr(np.array(pdf["v"].tolist(), float).reshape(len(pdf), m))
            q, r = np.hstack([q, np.zeros((len(q), m - q.shape[1]))]), np.vstack([r, np.zeros((m - len(r), m))])
            ids = np.concatenate([pdf["row_id"].to_numpy(), np.arange(m)])
            return pd.DataFrame({"b": pdf["b"].iloc[0], "q": np.arange(len(ids)) < len(pdf), "row_id": ids, "v": list(np.vstack([q, r]))})

        levels, rows, blocks = [], self.df.withColumn("b", F.floor(F.col("row_id") / max(TALL_ROWS, m)).cast("long")), -(-self.nrows // max(TALL_ROWS, m))
        while True:
            done = stored(rows.groupBy("b").applyInPandas(factor, "b long, q boolean, row_id long, v array<double>"), "qr")
            levels.append(done.filter("q").select("b", "row_id", "v"))
            triangles = done.filter("not q")
            if blocks == 1:
                r = np.zeros((m, m))
                for x in triangles.collect():
                    r[x.row_id] = x.v
                break
            # Triangle b becomes rows b m, b m + 1, ... of the next level, of which `fan` blocks share one factorisation.
            rows = triangles.select((F.col("b") * m + F.col("row_id")).alias("row_id"), "v").withColumn("b", F.floor(F.col("row_id") / (fan * m)).cast("long"))
            blocks = -(-blocks // fan)

        def spread(left, right):
            c = np.zeros((m, m))
            c[right["k"].to_numpy()] = np.array(right["w"].tolist(), float).reshape(len(right), m)
            return pd.DataFrame({"b": left["b"], "row_id": left["row_id"], "v": list(np.array(left["v"].tolist(), float).reshape(len(left), m) @ c)}, columns=["b", "row_id", "v"])

        q = levels.pop()
        while levels:
            # Rows b m ... of a level's Q are the factor of block b of the level below.
            upper = q.select(F.floor(F.col("row_id") / m).cast("long").alias("b"), (F.col("row_id") % m).cast("int").alias("k"), F.col("v").alias("w"))
            q = levels.pop().groupBy("b").cogroup(upper.groupBy("b")).applyInPandas(spread, "b long, row_id long, v array<double>")
        return q.select("row_id", "v"), r

    def _is_tall(self) -> bool:
        return self.ndim == 2 and self.nrows > TALL_ROWS and self.ncols ** 2 <= MOST_DENSE

    def qr(self) -> tuple[Array, Array]:
        """Thin Q and R with Q R = A.  A tall matrix stays distributed."""
        if self._is_tall():
            q, r = self._tall_qr()
            return Array(q, [self.nrows, self.ncols]), Array(r)
        q, r = np.linalg.qr(self._dense())
        return Array(q), Array(r)

    def svd(self) -> tuple[Array, Vector, Array]:
        """Thin U, s, V^T.  A tall matrix stays distributed: the SVD of R turns its Q into U."""
        if self._is_tall():
            q, r = self._tall_qr()
            u, s, vt = np.linalg.svd(r)
            return Array(q, [self.nrows, self.ncols]).matmul(Array(u)), Vector(s), Array(vt)
        u, s, vt = np.linalg.svd(self._dense(), full_matrices=False)
        return Array(u), Vector(s), Array(vt)

    def eigh(self) -> tuple[Vector, Array]:
        w, v = np.linalg.eigh(self._dense(True))
        return Vector(w), Array(v)

    def cholesky(self) -> Array:
        try:
            return Array(np.linalg.cholesky(self._dense(True)))
        except np.linalg.LinAlgError as e:
            raise ValueError("not positive definite") from e

    def pseudo_inv(self) -> Array:
        if self._is_tall():
            u, s, vt = self.svd()
            s, v = s.to_numpy(), vt.to_numpy().T
            return u.matmul(Array((v * np.where(s > 1e-10, 1 / np.where(s > 1e-10, s, 1), 0)).T)).transpose()
        u, s, vt = np.linalg.svd(self._dense(), full_matrices=False)
        return Array(vt.T @ np.diag(np.where(s > 1e-10, 1 / np.where(s > 1e-10, s, 1), 0)) @ u.T)

    def is_symmetric(self, tol: float = 1e-10) -> bool:
        a = self._dense()
        return a.shape[0] == a.shape[1] and bool((np.abs(a - a.T) <= tol).all())

    def is_positive_definite(self) -> bool:
        try:
            self.cholesky()
        except ValueError:
            return False
        return True

    # Networks
    def leaky_relu(self, alpha: float = 0.01) -> Array:
        return self._map(lambda x: nn.leaky_relu(x, alpha))

    def leaky_relu_deriv(self, alpha: float = 0.01) -> Array:
        return self._map(lambda x: nn.leaky_relu_deriv(x, alpha))

    def elu(self, alpha: float = 1.0) -> Array:
        return self._map(lambda x: nn.elu(x, alpha))

    def softmax(self) -> Array:
        return Array(self.df.select("row_id", nn.row_softmax("v").alias("v")), self._shape)

    def log_softmax(self) -> Array:
        return Array(self.df.select("row_id", nn.row_log_softmax("v").alias("v")), self._shape)

    def layer_norm(self, eps: float = 1e-5) -> Array:
        return Array(self.df.select("row_id", nn.row_layer_norm("v", eps).alias("v")), self._shape)

    def batch_norm(self, mu: Vector, sigma: Vector, gamma: Vector, beta: Vector) -> Array:
        m, s, g, b = (_constant(x.to_list()) for x in (mu, sigma, gamma, beta))
        at = lambda c, j: F.get(c, j)
        return self._map(lambda x, j: at(g, j) * ieee.div(x - at(m, j), at(s, j)) + at(b, j))

    def dropout(self, p: float, seed: int = 0) -> Array:
        """Each element is kept with probability 1 - p, by a hash of its place, and scaled."""
        if not 0 <= p < 1:
            raise ValueError("p outside [0, 1)")
        u = lambda j: F.pmod(F.xxhash64(F.lit(seed), "row_id", j), F.lit(1 << 30)) / float(1 << 30)
        return self._map(lambda x, j: F.when(u(j) >= p, x / (1 - p)).otherwise(0.0))

    def pad(self, top: int, bottom: int, left: int, right: int, val: float = 0.0) -> Array:
        r, c = self.shape
        rim = lambda n: F.array_repeat(F.lit(float(val)), n)
        inner = self.df.select((F.col("row_id") + top).alias("row_id"), F.concat(rim(left), "v", rim(right)).alias("v"))
        edge = _spark().range(r + top + bottom).filter((F.col("id") < top) | (F.col("id") >= r + top)).select(F.col("id").alias("row_id"), rim(c + left + right).alias("v"))
        return Array(inner.unionByName(edge), [r + top + bottom, c + left + right])

    def _pool(self, k: int, f) -> Array:
        r, c = self.shape
        if r % k or c % k:
            raise ValueError("dimensions do not divide")
        cells = self.cells().groupBy(F.floor(F.col("i") / k).alias("i"), F.floor(F.col("j") / k).alias("j")).agg(f("x").alias("x"))
        return Array.from_cells(cells, [r // k, c // k])

    def max_pool2d(self, k: int) -> Array:
        return self._pool(k, F.max)

    def avg_pool2d(self, k: int) -> Array:
        return self._pool(k, F.avg)

    def _loss(self, target: Array, name: str, **more) -> float:
        if self.shape != target.shape:
            raise ValueError("shapes do not match")
        return self._with(target, lambda p, t: nn.LOSSES[name](p, t, **more)).mean()

    def mse_loss(self, target: Array) -> float:
        return self._loss(target, "mse")

    def mae_loss(self, target: Array) -> float:
        return self._loss(target, "mae")

    def huber_loss(self, target: Array, delta: float = 1.0) -> float:
        return self._loss(target, "huber", delta=delta)

    def binary_cross_entropy(self, target: Array) -> float:
        return self._loss(target, "binary_cross_entropy")

    def _labelled(self, labels) -> DataFrame:
        return self.df.join(_spark().createDataFrame(list(enumerate(map(int, labels))), "row_id bigint, y int"), "row_id")

    def cross_entropy_loss(self, labels) -> float:
        return self._labelled(labels).agg(F.avg(-F.get("v", F.col("y"))).alias("r")).first().r

    def mse_grad(self, target: Array) -> Array:
        n = self.size
        return self._with(target, lambda p, t: 2 * (p - t) / n)

    def softmax_ce_grad(self, labels) -> Array:
        return Array(self.softmax()._labelled(labels).select("row_id", F.transform("v", lambda x, j: x - F.when(j == F.col("y"), 1.0).otherwise(0.0)).alias("v")), self._shape)


def _apply(f):
    return lambda self: self._map(f)


for _name, _f in {**ieee.ELEMENTWISE, **nn.ACTIVATIONS}.items():
    if _name not in Array.__dict__:
        setattr(Array, _name, _apply(_f))
