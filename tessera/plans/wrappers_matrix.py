"""Registered queries that run the API of arrays, tensors, files, distributions, signals and geometry against SQL (see wrappers)."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.api import geometry, linalg, nn, signal, special
from tessera.functions.distributions import Exponential, Normal, Poisson, StudentT
from tessera.operators.autograd import SGD, Adam, Tensor
from tessera.operators.complexvector import ComplexVector
from tessera.operators.matrix import Array
from tessera.operators.store import shared_dir
from tessera.operators.vector import Vector
from tessera.plans.registry import integral, r
from tessera.plans.registry import query as _query
from tessera.plans.registry import table as _t
from tessera.plans.wrappers import _columns, _marks, _per_nation, _sql_marks, _sql_per_nation, _sql_values, _values
from tessera.sources.files import LazyArray, MmapArray

_CELLS = "(SELECT i, j, x, i * 64 + j AS k FROM (SELECT vec_id AS i, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings))"


def _matrix(spark, sf_dir) -> Array:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))
    return Array(e, [e.count(), 64])


def _array_marks(arrays: dict, digits: int = 3):
    out = None
    for name, a in arrays.items():
        one = a.cells().agg(F.lit(name).alias("op"), F.count("*").alias("n"), r(F.sum(F.col("x") * (1 + (F.col("i") * a.shape[-1] + F.col("j")) % 7)), digits).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def _changed(a, f):
    f(c := a.copy())
    return c


_ARRAY = {
    "__add__": (lambda a: a + a, "x + x"), "__radd__": (lambda a: 2 + a, "2 + x"), "__sub__": (lambda a: a - a * 3, "x - x * 3"), "__rsub__": (lambda a: 2 - a, "2 - x"), "__mul__": (lambda a: a * a, "x * x"), "__rmul__": (lambda a: 3 * a, "3 * x"), "__truediv__": (lambda a: a / (a + 100), "x / (x + 100)"), "__rtruediv__": (lambda a: 2 / (a + 100), "2 / (x + 100)"),
    "__pow__": (lambda a: (a + 100) ** 1.5, "pow(x + 100, 1.5)"), "__neg__": (lambda a: -a, "-x"), "__pos__": (lambda a: +a, "x"), "__abs__": (lambda a: abs(a), "abs(x)"), "add_array": (lambda a: a.add_array(a), "x + x"), "sub_array": (lambda a: a.sub_array(a * 2), "-x"), "mul_array_elementwise": (lambda a: a.mul_array_elementwise(a), "x * x"), "div_array_elementwise": (lambda a: a.div_array_elementwise(a + 100), "x / (x + 100)"),
    "sub": (lambda a: a.sub(1.5), "x - 1.5"), "div": (lambda a: a.div(4), "x / 4"), "__iadd__": (lambda a: a.__iadd__(1), "x + 1"), "__isub__": (lambda a: a.__isub__(1), "x - 1"), "__imul__": (lambda a: a.__imul__(2), "x * 2"), "__itruediv__": (lambda a: a.__itruediv__(2), "x / 2"),
    "clamp": (lambda a: a.clamp(-0.1, 0.1), "least(greatest(x, -0.1), 0.1)"), "fma": (lambda a: a.fma(2, 3), "x * 2 + 3"), "where_scalar": (lambda a: a.where_scalar(a.gt(0), 5), "CASE WHEN x > 0 THEN x ELSE 5 END"), "normalize": (lambda a: a.normalize(0.5, 2.0), "(x - 0.5) / 2"), "lazy": (lambda a: a.lazy(), "x"), "copy": (lambda a: a.copy(), "x"),
    "reshape": (lambda a: a.reshape(a.nrows * 2, 32), "x"), "flatten": (lambda a: a.flatten(), "x"), "squeeze": (lambda a: a.expand_dims(0).squeeze(), "x"), "expand_dims": (lambda a: a.expand_dims(1), "x"), "from_list": (lambda a: Array.from_list(a.to_flat_list(), a.shape), "x"), "new": (lambda a: Array(a.to_list()), "x"),
    "from_numpy": (lambda a: Array.from_numpy(a.to_numpy()), "x"), "from_dataframe": (lambda a: Array.from_dataframe(a.to_dataframe()), "x"), "full": (lambda a: Array.full(*a.shape, 2.5), "2.5"), "zeros": (lambda a: Array.zeros(*a.shape), "0"), "ones": (lambda a: Array.ones(*a.shape), "1"), "zeros_nd": (lambda a: Array.zeros_nd(a.shape), "0"), "ones_nd": (lambda a: Array.ones_nd(a.shape), "1"),
    "sigmoid": (lambda a: nn.sigmoid(a), "1 / (1 + exp(-x))"), "leaky_relu_deriv": (lambda a: a.leaky_relu_deriv(0.1), "CASE WHEN x > 0 THEN 1 ELSE 0.1 END"), "mse_grad": (lambda a: a.mse_grad(a * 3) * a.size, "-4 * x"), "dropout": (lambda a: nn.dropout(a, 0.0), "x"), "astype": (lambda a: a.astype("float32"), "CAST(CAST(x AS FLOAT) AS DOUBLE)"),
    "batch_norm": (lambda a: nn.batch_norm(a, Vector.full(64, 0.5), Vector.full(64, 2.0), Vector.arange(64), Vector.ones(64)), "j * (x - 0.5) / 2 + 1"), "__setitem__": (lambda a: _changed(a, lambda c: c.__setitem__((3, 4), 9.0)), "CASE WHEN i = 3 AND j = 4 THEN 9 ELSE x END"),
    "__getitem__": (lambda a: a[2:40:3, 1:64:7], ("x", "((i - 2) // 3) * 9 + (j - 1) // 7", "i >= 2 AND i < 40 AND (i - 2) % 3 = 0 AND j >= 1 AND (j - 1) % 7 = 0")), "pad": (lambda a: a.pad(1, 2, 3, 4, 0.0)[1 : a.nrows + 1, 3:67], "x"), "transpose": (lambda a: linalg.transpose(a), ("x", "j * size // 64 + i", "true")),
    "eye": (lambda a: Array.eye(64), ("CASE WHEN i = j THEN 1 ELSE 0 END", "k", "i < 64")), "softmax_ce_grad": (lambda a: a.softmax_ce_grad([i % 64 for i in range(a.nrows)]), "exp(x) / (SELECT sum(exp(o.x)) FROM (SELECT vec_id AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) o WHERE o.i = q.i) - CASE WHEN j = i % 64 THEN 1 ELSE 0 END"),
}
# The row sums that softmax_ce_grad needs are joined once, not looked up for every cell.
_SOFT = "(SELECT *, sum(exp(x)) OVER (PARTITION BY i) AS z FROM " + _CELLS + ")"


def _array_sql() -> str:
    plain = {k: (e if isinstance(e, tuple) else (e, "k", "true")) for k, (_, e) in _ARRAY.items() if k != "softmax_ce_grad"}
    return _sql_marks(plain, _CELLS) + " UNION ALL " + _sql_marks({"softmax_ce_grad": ("exp(x) / z - CASE WHEN j = i % 64 THEN 1 ELSE 0 END", "k", "true")}, _SOFT)


@_query(_array_sql())
def array_arithmetic(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return _array_marks({k: f(a) for k, (f, _) in _ARRAY.items()})


_ARRAY_ONE = "(SELECT max(i) + 1 AS n, sum(x) AS s, avg(x) AS m, var_samp(x) AS v, stddev_samp(x) AS d, min(x) AS lo, max(x) AS hi, arg_min(k, (x, k)) AS at_lo, arg_max(k, (x, k)) AS at_hi, product(1 + x / 1000) AS p, sqrt(sum(x * x)) AS f, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS pos, sum(x) FILTER (i = 3) AS r3, sum(x) FILTER (j = 5) AS c5, max(x) FILTER (i = 3 AND j = 5) AS x35, sum(x) FILTER (i = j) AS t, sum(x) FILTER (j = i % 64) AS ce FROM " + _CELLS + ")"
_ARRAY_VALUES = {
    "shape": (lambda a: a.shape[0] * 100 + a.shape[1], "n * 100 + 64"), "ndim": (lambda a: a.ndim, "2"), "size": (lambda a: a.size, "n * 64"), "nrows": (lambda a: a.nrows, "n"), "ncols": (lambda a: a.ncols, "64"), "__len__": (lambda a: len(a), "n"), "sklearn_shape": (lambda a: a.sklearn_shape()[1], "64"), "validate_sklearn": (lambda a: a.validate_sklearn() is None, "1"),
    "sum_all": (lambda a: a.sum_all(), "s"), "mean": (lambda a: a.mean(), "m"), "variance": (lambda a: a.variance(), "v"), "std_dev": (lambda a: a.std_dev(), "d"), "min": (lambda a: a.min(), "lo"), "max": (lambda a: a.max(), "hi"), "argmin": (lambda a: a.argmin(), "at_lo"), "argmax": (lambda a: a.argmax(), "at_hi"), "prod": (lambda a: (a / 1000 + 1).prod(), "p"),
    "norm_frobenius": (lambda a: linalg.norm_frobenius(a), "f"), "trace": (lambda a: a[:64, :64].trace(), "t"), "gt": (lambda a: sum(a.gt(0)), "pos"), "lt": (lambda a: sum(a.lt(0)), "n * 64 - pos"), "ge": (lambda a: sum(a.ge(0)), "pos"), "le": (lambda a: sum(a.le(0)), "n * 64 - pos"), "eq_scalar": (lambda a: sum((a * 0).eq_scalar(0)), "n * 64"), "ne_scalar": (lambda a: sum(a.ne_scalar(0)), "n * 64"),
    "isnan": (lambda a: sum(a.isnan()), "0"), "isfinite": (lambda a: sum(a.isfinite()), "n * 64"), "isinf": (lambda a: sum(a.isinf()), "0"), "is_prime": (lambda a: sum((a * 0 + 7).is_prime()), "n * 64"), "get_row": (lambda a: sum(a.get_row(3)), "r3"), "get_col": (lambda a: sum(a.get_col(5)), "c5"), "__getitem__": (lambda a: a[3, 5], "x35"),
    "to_list": (lambda a: a.to_list()[3][5], "x35"), "tolist": (lambda a: a.tolist()[3][5], "x35"), "to_flat_list": (lambda a: a.to_flat_list()[3 * 64 + 5], "x35"), "to_flat_py": (lambda a: sum(a.to_flat_py()), "s"), "to_numpy": (lambda a: a.to_numpy().sum(), "s"), "__array__": (lambda a: np.asarray(a)[3, 5], "x35"), "to_dataframe": (lambda a: a.to_dataframe().iloc[3, 5], "x35"), "to_series": (lambda a: a.to_series().sum(), "s"),
    "__dlpack__": (lambda a: np.from_dlpack(a).sum(), "s"), "__dlpack_device__": (lambda a: a.__dlpack_device__()[0], "1"), "into_vector": (lambda a: a.into_vector().sum(), "s"), "estimated_bytes": (lambda a: a.estimated_bytes(), "7 + 16 + 8 * n * 64"), "memory_bytes": (lambda a: a.memory_bytes(), "8 * n * 64"), "__repr__": (lambda a: repr(a).startswith("Array("), "1"), "dtype": (lambda a: a.dtype == "float64", "1"),
    "matmul_trans": (lambda a: a.matmul_trans(Vector.ones(a.nrows)).sum(), "s"), "cross_entropy_loss": (lambda a: a.cross_entropy_loss([i % 64 for i in range(a.nrows)]), "-ce / n"), "nn.cross_entropy_loss": (lambda a: nn.cross_entropy_loss(a, [i % 64 for i in range(a.nrows)]), "-ce / n"), "is_symmetric": (lambda a: a.gram_matrix().is_symmetric(1e-6), "1"), "is_positive_definite": (lambda a: (a.gram_matrix() + Array.eye(64) * 0.1).is_positive_definite(), "1"),
}


@_query(_sql_values({k: e for k, (_, e) in _ARRAY_VALUES.items()}, _ARRAY_ONE, 4))
def array_values(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return _values(spark, {k: f(a) for k, (f, _) in _ARRAY_VALUES.items()}, 4)


_SQUARE = "(SELECT a, b, c, a * c - b * b AS d, (a + c) / 2 AS h, sqrt((a - c) * (a - c) / 4 + b * b) AS w FROM (SELECT avg(l_quantity * l_quantity) / 100 AS a, avg(l_quantity * l_discount) AS b, avg(l_discount * l_discount) * 1000 AS c FROM lineitem))"
_SPREAD = {
    "inv": (lambda m: linalg.inv(m)[0, 1], "-b / d"), "Array.inv": (lambda m: m.inv()[1, 1], "a / d"), "solve": (lambda m: linalg.solve(m, Array([[1.0], [2.0]]))[0, 0], "(c - 2 * b) / d"), "Array.solve": (lambda m: m.solve(Array([[1.0], [2.0]]))[1, 0], "(2 * a - b) / d"), "det": (lambda m: linalg.det(m), "d"), "Array.det": (lambda m: m.det(), "d"), "rank": (lambda m: linalg.rank(m), "2"), "Array.rank": (lambda m: m.rank(), "2"),
    "Array.trace": (lambda m: m.trace(), "a + c"), "Array.norm_frobenius": (lambda m: m.norm_frobenius(), "sqrt(a * a + 2 * b * b + c * c)"), "qr": (lambda m: abs(linalg.qr(m)[1][0, 0]), "sqrt(a * a + b * b)"), "Array.qr": (lambda m: abs(m.qr()[1][1, 1]), "d / sqrt(a * a + b * b)"), "qr product": (lambda m: (m.qr()[0] @ m.qr()[1])[0, 1], "b"), "svd": (lambda m: linalg.svd(m)[1][0], "h + w"), "Array.svd": (lambda m: m.svd()[1][1], "h - w"),
    "eigh": (lambda m: linalg.eigh(m)[0][0], "h - w"), "Array.eigh": (lambda m: m.eigh()[0][1], "h + w"), "cholesky": (lambda m: linalg.cholesky(m)[1, 0], "b / sqrt(a)"), "Array.cholesky": (lambda m: m.cholesky()[1, 1], "sqrt(c - b * b / a)"), "pseudo_inv": (lambda m: linalg.pseudo_inv(m)[0, 0], "c / d"), "Array.pseudo_inv": (lambda m: m.pseudo_inv()[1, 0], "-b / d"), "transpose": (lambda m: linalg.transpose(m)[0, 1], "b"),
    "is_symmetric": (lambda m: m.is_symmetric(), "1"), "is_positive_definite": (lambda m: m.is_positive_definite(), "1"), "correlation_matrix": (lambda m: Array([[1.0, 2.0, 4.0], [2.0, 1.0, 3.0]]).correlation_matrix()[0, 1], "0.6546536707079771"),
}


@_query(_sql_values({k: e for k, (_, e) in _SPREAD.items()}, _SQUARE))
def factorisations(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    row = _t(spark, sf_dir, "lineitem").agg((F.avg(q * q) / 100).alias("a"), F.avg(q * d).alias("b"), (F.avg(d * d) * 1000).alias("c")).first()
    m = Array([[row.a, row.b], [row.b, row.c]])
    return _values(spark, {k: f(m) for k, (f, _) in _SPREAD.items()})


_TALL = "(SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem)"
_DET = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"


@_query(_sql_values({"r00": "sqrt(aa)", "r01": "ab / sqrt(aa)", "r11": "sqrt(bb - ab * ab / aa)", "det": f"sqrt({_DET})", "squares": "aa + bb + cc", "product": f"sqrt({_DET})", "rows": "n", "back": "sa + 2 * sb + 3 * sc"}, "(SELECT count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM " + _TALL + ")", 4))
def tall_factorisations(spark, sf_dir):
    """QR and SVD of a matrix of all rows of lineitem, which stays distributed."""
    a = Array.from_table(_t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c")), ["a", "b", "c"], "a", "b", "c")
    (q, upper), (_, s, _) = a.qr(), a.svd()
    upper, s = upper.to_numpy(), s.to_numpy()
    back = Vector(q.matmul(Array(upper)).df.select(F.col("row_id").alias("idx"), (F.get("v", F.lit(0)) + 2 * F.get("v", F.lit(1)) + 3 * F.get("v", F.lit(2))).alias("x")))
    return _values(spark, {"r00": abs(upper[0, 0]), "r01": abs(upper[0, 1]), "r11": abs(upper[1, 1]), "det": abs(np.prod(np.diag(upper))), "squares": (s**2).sum(), "product": s.prod(), "rows": len(back), "back": back.sum()}, 4)


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/{uuid.uuid4().hex}-{name}"


@_query(_sql_marks({k: e if isinstance(e, tuple) else (e, "k", "true") for k, e in {
    "save load": "x", "save_bin": "x", "save_csv": "x", "save_csv header": "x", "safetensors": "x", "LazyArray.open": "x", "sin": "sin(x)", "cos": "cos(x)", "exp": "exp(x)", "sigmoid": "1 / (1 + exp(-x))", "add": "x + 1.5", "mul": "x * 2", "abs": "abs(x)", "pow": "x * x", "execute": "2 * x + 1", "load_rows": ("x", "k - 64 * 10", "i >= 10 AND i < 30"), "chunks": ("x", "k - 64 * 400", "i >= 400 AND i < 500"), "open_bin": "x", "mmap": "x", "mmap load_rows": ("x", "k - 64 * 10", "i >= 10 AND i < 30"), "mmap chunks": ("x", "k - 64 * 400", "i >= 400 AND i < 500"),
}.items()}, _CELLS))
def matrix_files(spark, sf_dir):
    """Round trips of the whole matrix through every format, and lazy readers over them."""
    a = _matrix(spark, sf_dir)
    whole, raw, csv, headed, tensors = (_path(spark, n) for n in ("a.rmath", "a.bin", "a.csv", "b.csv", "a.safetensors"))
    a.save(whole), a.save_bin(raw), a.save_csv(csv), a.save_csv(headed, [f"n{i}" for i in range(64)]), a.save_safetensors(tensors, "w")
    lazy, mapped = LazyArray.open(spark, whole), MmapArray.mmap(spark, raw, a.nrows, 64)
    return _array_marks({
        "save load": Array.load(whole), "save_bin": LazyArray.open_bin(spark, raw, a.nrows, 64).load(), "save_csv": Array.load_csv(csv), "save_csv header": Array.load_csv_with_header(headed)[0], "safetensors": Array.load_safetensors(tensors, "w"),
        "LazyArray.open": lazy.load(), "sin": lazy.sin().load(), "cos": lazy.cos().load(), "exp": lazy.exp().load(), "sigmoid": lazy.sigmoid().load(), "add": lazy.add(1.5).load(), "mul": lazy.mul(2).load(), "abs": lazy.abs().load(), "pow": lazy.pow(2).load(), "execute": lazy.mul(2).add(1).execute(), "load_rows": lazy.load_rows(10, 30), "chunks": list(lazy.chunks(100))[4],
        "open_bin": LazyArray.open_bin(spark, raw, a.nrows, 64).load(), "mmap": mapped.load_all(), "mmap load_rows": mapped.load_rows(10, 30), "mmap chunks": list(mapped.chunks(100))[4],
    })


@_query(_sql_values({"peek": "n * 100 + 64", "sum": "s", "sum of steps": "2 * s + n * 64", "__repr__": "1", "chunk count": "ceil(n / 100.0)", "get_row": "r3", "get_element": "x35", "shape": "n", "header": "64"}, _ARRAY_ONE, 4))
def lazy_array_values(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    whole, raw, csv = (_path(spark, n) for n in ("a.rmath", "a.bin", "a.csv"))
    a.save(whole), a.save_bin(raw), a.save_csv(csv, [f"n{i}" for i in range(64)])
    lazy, mapped = LazyArray.open(spark, whole), MmapArray.mmap(spark, raw, a.nrows, 64)
    return _values(spark, {"peek": lazy.peek()[0] * 100 + lazy.peek()[1], "sum": lazy.sum(), "sum of steps": lazy.mul(2).add(1).sum(), "__repr__": repr(lazy.abs()).endswith("1 steps)"), "chunk count": sum(1 for _ in lazy.chunks(100)), "get_row": sum(mapped.get_row(3)), "get_element": mapped.get_element(3, 5), "shape": mapped.shape[0], "header": len(Array.load_csv_with_header(csv)[1])}, 4)


# Tensors -------------------------------------------------------------------------------------------------------------

#: name: (function of tensors x, y, its value by element in SQL, its slope in x).
_TENSOR = {
    "__add__": (lambda x, y: x + y, "x + y", "1"), "__radd__": (lambda x, y: 2 + x, "2 + x", "1"), "__sub__": (lambda x, y: x - y, "x - y", "1"), "__rsub__": (lambda x, y: 2 - x, "2 - x", "-1"), "__mul__": (lambda x, y: x * y, "x * y", "y"), "__rmul__": (lambda x, y: 3 * x, "3 * x", "3"), "__truediv__": (lambda x, y: x / y, "x / y", "1 / y"), "__rtruediv__": (lambda x, y: 2 / (x + 1), "2 / (x + 1)", "-2 / pow(x + 1, 2)"),
    "__neg__": (lambda x, y: -x, "-x", "-1"), "sigmoid": (lambda x, y: x.sigmoid(), "1 / (1 + exp(-x))", "exp(-x) / pow(1 + exp(-x), 2)"), "relu": (lambda x, y: (x - 2.1).relu(), "greatest(x - 2.1, 0)", "CASE WHEN x > 2.1 THEN 1 ELSE 0 END"), "exp": (lambda x, y: x.exp(), "exp(x)", "exp(x)"), "log": (lambda x, y: (x + 1).log(), "ln(x + 1)", "1 / (x + 1)"),
    "tanh": (lambda x, y: x.tanh(), "(exp(x) - exp(-x)) / (exp(x) + exp(-x))", "4 / pow(exp(x) + exp(-x), 2)"), "abs": (lambda x, y: (x - 2.1).abs(), "abs(x - 2.1)", "sign(x - 2.1)"), "reshape": (lambda x, y: x.reshape(5, 5).reshape(25), "x", "1"), "transpose": (lambda x, y: x.reshape(5, 5).transpose().t().reshape(25), "x", "1"), "chain": (lambda x, y: (x * y).sigmoid() * x, "x / (1 + exp(-x * y))", "1 / (1 + exp(-x * y)) + x * y * exp(-x * y) / pow(1 + exp(-x * y), 2)"),
}
_TENSOR_SQL = {k: x for name, (_, v, d) in _TENSOR.items() for k, x in ((name, f"sum(({v}) * (1 + k % 7))"), (f"{name} grad", f"sum(({d}) * (1 + k % 7) * (1 + k % 3))"))}
_TENSOR_MORE = {
    "sum": "sum(x)", "sum grad": "sum(1 + k % 3)", "mean": "avg(x)", "mean grad": "sum(1 + k % 3) / 25", "__matmul__": "sum(x * x)", "__matmul__ grad": "sum(2 * x * (1 + k % 3))", "shape": "25", "ndim": "1", "dtype": "1", "__getitem__": "max(x) FILTER (k = 3)", "zeros": "0", "ones": "4", "from_array": "sum(x)", "update_data": "sum(2 * x)", "set_grad": "25", "zero_grad": "1", "requires_grad_": "1", "requires_grad": "0", "build_topo": "3", "__repr__": "1",
    "SGD.step": "sum((x - 0.1 * 2 * (x - y)) * (1 + k % 3))", "SGD.zero_grad": "1", "SGD momentum": "sum((x - 0.2 * (x - y) - 0.5 * 0.2 * (x - y) - 0.2 * (x - 0.2 * (x - y) - y)) * (1 + k % 3))", "Adam.step": "sum((x - 0.01 * sign(x - y)) * (1 + k % 3))", "Adam.zero_grad": "1", "new": "sum(x)", "data": "sum(x)", "grad": "1",
}


@_query(_sql_values(_TENSOR_SQL | {k: f"max({e})" if e.isdigit() else e for k, e in _TENSOR_MORE.items()}, "(SELECT n_nationkey / 4.0 AS x, n_regionkey + 1.0 AS y, n_nationkey AS k FROM nation)", 4))
def tensor_methods(spark, sf_dir):
    rows = sorted(_t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())
    xs, ys = np.array([n.n_nationkey / 4 for n in rows]), np.array([n.n_regionkey + 1.0 for n in rows])
    k = np.arange(25)
    seven, three, found = 1 + k % 7, 1 + k % 3, {}
    for name, (f, _, _) in _TENSOR.items():
        x = Tensor(xs, True)
        out = f(x, Tensor(ys))
        (out * seven).sum().backward()
        found |= {name: (out.data * seven).sum(), f"{name} grad": (x.grad * three).sum()}
    for name, f in (("sum", lambda t: t.sum()), ("mean", lambda t: t.mean()), ("__matmul__", lambda t: (t.reshape(1, 25) @ t.reshape(25, 1)).sum())):
        x = Tensor(xs, True)
        out = f(x)
        out.backward()
        found |= {name: out.data.sum(), f"{name} grad": (x.grad * three).sum()}
    x = Tensor(xs)
    topo = len((x.requires_grad_() + 1).build_topo())
    x.set_grad(np.ones(25))
    set_grad = x.grad.sum()
    x.zero_grad()
    cleared = x.grad is None
    x.update_data(xs * 2)
    found |= {"shape": Tensor(xs).shape[0], "ndim": Tensor(xs).ndim, "dtype": Tensor(xs).dtype == "float64", "__getitem__": float(Tensor(xs)[3].data), "zeros": Tensor.zeros([2, 2]).data.sum(), "ones": Tensor.ones([2, 2]).data.sum(), "from_array": Tensor.from_array(Array([xs.tolist()])).data.sum(), "update_data": x.data.sum(), "set_grad": set_grad, "zero_grad": cleared, "requires_grad_": x.requires_grad, "requires_grad": Tensor(xs).requires_grad, "build_topo": topo, "__repr__": repr(x).startswith("Tensor("), "new": Tensor(xs).data.sum(), "data": Tensor(xs).data.sum(), "grad": Tensor(xs).grad is None}
    for name, make, steps in (("SGD.step", lambda p: SGD([p], 0.1), 1), ("SGD momentum", lambda p: SGD([p], 0.1, 0.5), 2), ("Adam.step", lambda p: Adam([p], 0.01), 1)):
        p = Tensor(xs, True)
        optimiser = make(p)
        for _ in range(steps):
            optimiser.zero_grad()
            ((p - ys) * (p - ys)).sum().backward()
            optimiser.step()
        found[name] = (p.data * three).sum()
        optimiser.zero_grad()
        found[f"{name.split('.')[0].split()[0]}.zero_grad"] = p.grad is None
    return _values(spark, found, 4)


# Distributions, special functions, signals, geometry -------------------------------------------------------------------


_T = "exp(lgamma(3.0) - lgamma(2.5)) / sqrt(5 * pi()) / 2 * pow(1 + pow(($t - 1) / 2, 2) / 5, -3)"
_NORMAL_CDF = f"0.5 + {integral('exp(-0.5 * pow(($t - 1) / 2, 2)) / (2 * sqrt(2 * pi()))', '1', 'x')}"
_T_CDF = f"0.5 + {integral(_T, '1', 'x')}"
_LAWS = {
    "Normal.mean": (lambda x, y: Normal(1, 2).mean(), "1"), "Normal.pdf": (lambda x, y: Normal(1, 2).pdf(x), "exp(-0.5 * pow((x - 1) / 2, 2)) / (2 * sqrt(2 * pi()))"), "Normal.cdf": (lambda x, y: Normal(1, 2).cdf(x), _NORMAL_CDF), "Normal.ppf": (lambda x, y: Normal(1, 2).ppf(Normal(1, 2).cdf(x)), "x"), "Normal.new": (lambda x, y: Normal(x, y).sigma, "y"),
    "StudentT.pdf": (lambda x, y: StudentT(1, 2, 5).pdf(x), _T.replace("$t", "x")), "StudentT.cdf": (lambda x, y: StudentT(1, 2, 5).cdf(x), _T_CDF), "StudentT.ppf": (lambda x, y: StudentT(1, 2, 5).ppf(StudentT(1, 2, 5).cdf(x)), "x"), "StudentT.new": (lambda x, y: StudentT(x, y, 3).scale, "y"),
    "Poisson.cdf": (lambda x, y: Poisson(3).cdf(y), "(SELECT sum(exp(g * ln(3) - 3 - lgamma(g + 1.0))) FROM range(6) u(g) WHERE g <= y)"), "Poisson.pmf": (lambda x, y: Poisson(3).pmf(y), "exp(y * ln(3) - 3 - lgamma(y + 1))"), "Poisson.new": (lambda x, y: Poisson(y).rate, "y"), "Exponential.ppf": (lambda x, y: Exponential(y).ppf(0.3), "-ln(0.7) / y"), "Exponential.cdf": (lambda x, y: Exponential(y).cdf(x), "1 - exp(-x * y)"), "Exponential.new": (lambda x, y: Exponential(y).rate, "y"),
    "erf": (lambda x, y: special.erf(x / 2), f"2 / sqrt(pi()) * {integral('exp(-$t * $t)', '0', 'x / 2')}"), "gamma": (lambda x, y: special.gamma(y), "gamma(y)"), "ln_gamma": (lambda x, y: special.ln_gamma(x + 0.5), "lgamma(x + 0.5)"),
}


@_query(_sql_per_nation(_LAWS))
def laws(spark, sf_dir):
    return _per_nation(spark, sf_dir, _LAWS, lambda x, y: (x, y))


_DFT = "(SELECT f AS i, sum(x * cos(2 * pi() * ((f * k) % 25) / 25)) AS re, -sum(x * sin(2 * pi() * ((f * k) % 25) / 25)) AS im FROM (SELECT n_nationkey AS k, exp(n_regionkey / 3.0) + n_nationkey * n_nationkey / 50.0 AS x FROM nation), range(25) u(f) GROUP BY f)"


@_query(_sql_marks({"fft mags": "sqrt(re * re + im * im)", "fft phases": "atan2(im, re)", "fft_styled mags": "sqrt(re * re + im * im)", "fft_styled phases": "atan2(im, re)", "rfft": ("sqrt(re * re + im * im)", "i", "i < 13"), "mask_inplace": ("CASE WHEN i % 2 = 0 THEN sqrt(re * re + im * im) ELSE 0 END", "i", "true"), "new": ("sqrt(i * i + 1.0)", "i", "true"), "__len__": ("25", "0", "i = 0")}, _DFT, 4) + " UNION ALL " + _sql_marks({"ifft": "x"}, "(SELECT n_nationkey AS i, exp(n_regionkey / 3.0) + n_nationkey * n_nationkey / 50.0 AS x FROM nation)", 4))
def transforms(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), (F.exp(F.col("n_regionkey") / 3.0) + F.col("n_nationkey") * F.col("n_nationkey") / 50.0).alias("x"))
    v = Vector(rows)
    spectrum, (mags, phases) = signal.fft(v), signal.fft_styled(v)
    half = signal.fft(v)
    half.mask_inplace([i % 2 == 0 for i in range(25)])
    return _marks({"fft mags": spectrum.to_mags(), "fft phases": spectrum.to_phases(), "fft_styled mags": mags, "fft_styled phases": phases, "rfft": signal.rfft(v), "mask_inplace": half.to_mags(), "new": ComplexVector(list(range(25)), [1.0] * 25).to_mags(), "__len__": Vector([float(len(spectrum))]), "ifft": signal.ifft(spectrum)}, 4)


@_query(_sql_marks({"projection": "y * (SELECT sum(x * y) / sum(y * y) FROM (SELECT p_retailprice / 100 AS x, p_size AS y FROM part))", "angle_between": ("(SELECT acos(sum(x * y) / sqrt(sum(x * x) * sum(y * y))) FROM (SELECT p_retailprice / 100 AS x, p_size AS y FROM part))", "0", "i = 0")}, "(SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, CAST(p_size AS DOUBLE) AS y FROM part)", 3))
def vector_geometry(spark, sf_dir):
    x, y = _columns(spark, sf_dir)
    return _marks({"projection": geometry.projection(x, y), "angle_between": Vector([geometry.angle_between(x, y)])})


_CROSS = "((({1}.x - {0}.x) * ({2}.y - {0}.y) - ({1}.y - {0}.y) * ({2}.x - {0}.x)))"
_POINTS = "SELECT DISTINCT CAST((n_nationkey * 7) % 11 AS DOUBLE) AS x, CAST((n_nationkey * 5 + n_regionkey) % 13 AS DOUBLE) AS y FROM nation"


@_query(f"""WITH p AS ({_POINTS}) SELECT x, y FROM p WHERE NOT EXISTS (SELECT 1 FROM p a, p b, p c WHERE (a.x, a.y) <> (p.x, p.y) AND (b.x, b.y) <> (p.x, p.y) AND (c.x, c.y) <> (p.x, p.y)
  AND {_CROSS.format('a', 'b', 'c')} > 0 AND {_CROSS.format('a', 'b', 'p')} >= 0 AND {_CROSS.format('b', 'c', 'p')} >= 0 AND {_CROSS.format('c', 'a', 'p')} >= 0)
  AND NOT EXISTS (SELECT 1 FROM p a, p b WHERE (a.x, a.y) <> (p.x, p.y) AND (b.x, b.y) <> (p.x, p.y) AND {_CROSS.format('a', 'b', 'p')} = 0 AND (a.x - p.x) * (b.x - p.x) + (a.y - p.y) * (b.y - p.y) < 0)""")
def hull_of_nations(spark, sf_dir):
    k, g = F.col("n_nationkey"), F.col("n_regionkey")
    points = _t(spark, sf_dir, "nation").select(F.pmod(k * 7, F.lit(11)).cast("double").alias("x"), F.pmod(k * 5 + g, F.lit(13)).cast("double").alias("y")).collect()
    return spark.createDataFrame([(float(x), float(y)) for x, y in geometry.convex_hull([p.x for p in points], [p.y for p in points])], "x double, y double")
