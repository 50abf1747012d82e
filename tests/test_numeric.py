"""Vectors, matrices, scalars, gradients and files against NumPy, math and hand-worked values."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions, ieee
from tessera.functions.special import digamma_value
from tessera.operators import geometry, ordered, signal, table
from tessera.operators.autograd import SGD, Adam, Node, Tensor, fit, loss_and_gradients
from tessera.operators.lazy import from_list, loop_range
from tessera.operators.matrix import Array
from tessera.operators.scalar import Complex, Dual, Quaternion, Scalar, find_root_newton, integrate_simpson
from tessera.operators.vector import Vector
from tessera.sources import files

NAN, INF = math.nan, math.inf


def test_ieee_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 0.0), (5.0, 2.0), (-5.0, 2.0), (INF, 1.0)], "a double, b double")
    rows = df.select(ieee.div(F.col("a"), F.col("b")).alias("q"), ieee.mod(F.col("a"), F.col("b")).alias("m"), ieee.ln(F.col("a")).alias("l"), ieee.floor(F.col("a")).alias("f"), ieee.round_(F.col("a") / 2).alias("r"), ieee.compare(F.col("a"), "gt", 0.5).alias("g"), ieee.compare(F.col("a"), "ne", 1.0).alias("n")).collect()
    assert [x.q for x in rows[:2]] == [INF, -INF] and math.isnan(rows[2].q) and math.isnan(rows[3].q)
    assert rows[4].m == 1 and rows[5].m == -1 and math.isnan(rows[0].m)
    assert rows[2].l == -INF and math.isnan(rows[1].l) and rows[6].f == INF
    assert rows[4].r == 3 and rows[5].r == -3
    assert [x.g for x in rows] == [True, False, False, False, True, False, True] and rows[3].n


def test_vector(spark):
    v = Vector([3.0, 1.0, 4.0, 1.0, 5.0])
    assert v.to_list() == [3, 1, 4, 1, 5] and len(v) == 5 and v[-1] == 5 and v[1:4:2].to_list() == [1, 1]
    assert (v + v).to_list() == [6, 2, 8, 2, 10] and (2 - v).to_list() == [-1, 1, -2, 1, -3] and (v % 2).to_list() == [1, 1, 0, 1, 1]
    assert v.sum() == 14 and v.prod() == 60 and v.argmin() == 1 and v.argmax() == 4 and v.median() == 3 and v.mode() == 1
    assert v.percentile(50) == 3 and v.iqr() == 3 and v.mad() == 2 and v.norm_inf() == 5
    assert v.cumsum().to_list() == [3, 4, 8, 9, 14] and v.cumprod().to_list() == [3, 3, 12, 12, 60] and v.diff().to_list() == [-2, 3, -3, 4]
    assert v.sort().to_list() == [1, 1, 3, 4, 5] and v.sort_desc()[0] == 5 and v.argsort() == [1, 3, 0, 2, 4] and v.unique().to_list() == [3, 1, 4, 5]
    assert v.reverse().to_list() == [5, 1, 4, 1, 3] and v.head(2).to_list() == [3, 1] and v.tail(2).to_list() == [1, 5]
    assert v.filter_gt(2).to_list() == [3, 4, 5] and v.filter_by_mask([1, 0, 0, 1, 0]).to_list() == [3, 1] and (v > 2) == [True, False, True, False, True]
    assert v.append(9).to_list()[-1] == 9 and v.extend(v).sum() == 28 and [x["values"] for x in v.chunks(2).orderBy("chunk").collect()] == [[3, 1], [4, 1], [5]]
    assert np.allclose(v.softmax().to_numpy().sum(), 1) and np.allclose(v.standardize().to_numpy(), (v.to_numpy() - 2.8) / np.std(v.to_numpy(), ddof=1))
    assert Vector.arange(5).to_list() == [0, 1, 2, 3, 4] and Vector.linspace(0, 1, 3).to_list() == [0, 0.5, 1] and Vector.sum_range(5) == 10
    assert Vector([]).sum() == 0 and math.isnan(Vector([]).mean()) and Vector([]).argmax() == -1
    assert Vector([NAN, 2.0]).min() == 2 and Vector([NAN, 2.0]).filter_gt(1).to_list() == [2] and Vector([2.0, 4.0, 9.0]).is_prime() == [True, False, False]
    with pytest.raises(ZeroDivisionError):
        v / 0
    with pytest.raises(ValueError):
        v + Vector([1.0])
    a, b = Vector.multi_filter_where([v, v * 10], [(v, "gt", 1), (v, "<", 5)])
    assert a.to_list() == [3, 4] and b.to_list() == [30, 40]


def test_running_operators_across_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 7).cast("double").alias("x"))
    got = ordered.running(df, lambda c: F.sum(c or "x"), lambda a, b: a + b, "c", block=64).orderBy("idx").collect()
    assert [r.c for r in got] == np.cumsum(np.arange(1000) % 7).tolist()
    nexts = ordered.with_next(df, ["x"], block=64).orderBy("idx").collect()
    assert [r.next_x for r in nexts[:-1]] == ((np.arange(1, 1000)) % 7).tolist() and nexts[-1].next_x is None


def test_table_and_lazy(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (3.0, "c")], "x double, s string")
    assert [r.s for r in table.filter_where(df, [("x", "ne", 1.0)]).orderBy("s").collect()] == ["b", "c"]
    assert [r.s for r in table.filter_finite(df, "x").orderBy("s").collect()] == ["a", "c"]
    assert loop_range(10).mul(2).filter_gt(5).sum() == 84 and loop_range(4).var() == 1.25
    assert from_list([1.0, NAN]).filter_gt(0).to_vector().isnan() == [False, True] and len(loop_range(10).filter_gt(5)) == 10


def test_array(spark):
    a = np.array([[1.0, 2.0], [3.0, 4.0]])
    x = Array(a)
    assert x.shape == [2, 2] and np.allclose((x @ x).to_numpy(), a @ a) and np.allclose(x.inv().to_numpy(), np.linalg.inv(a)) and np.isclose(x.det(), -2)
    assert np.allclose((x + Array([[10.0, 20.0]])).to_numpy(), a + [10, 20]) and np.allclose((x * Array([[2.0], [3.0]])).to_numpy(), a * [[2], [3]])
    assert np.allclose(x.transpose().to_numpy(), a.T) and x.trace() == 5 and x.rank() == 2 and x[1, 0] == 3 and np.allclose(x[:, 1:].to_numpy(), a[:, 1:])
    assert np.allclose(x.gram_matrix().to_numpy(), a.T @ a) and np.allclose(x.covariance().to_numpy(), np.cov(a.T)) and x.sum(0).to_list() == [4, 6] and x.sum(1).to_list() == [3, 7]
    q, r = x.qr()
    assert np.allclose(q.to_numpy() @ r.to_numpy(), a)
    u, s, vt = x.svd()
    assert np.allclose(u.to_numpy() @ np.diag(s.to_list()) @ vt.to_numpy(), a)
    spd = Array([[4.0, 2.0], [2.0, 3.0]])
    assert spd.is_positive_definite() and spd.is_symmetric() and np.allclose(spd.cholesky().to_numpy(), np.linalg.cholesky(spd.to_numpy()))
    assert np.allclose(x.pseudo_inv().to_numpy(), np.linalg.pinv(a)) and np.allclose(x.solve(Array([[1.0], [2.0]])).to_numpy(), np.linalg.solve(a, [[1], [2]]))
    assert np.allclose(x.softmax().to_numpy().sum(1), 1) and x.reshape(1, 4).to_list() == [[1, 2, 3, 4]] and x.flatten().shape == [1, 4]
    assert x.pad(1, 0, 0, 1, 9).to_list() == [[9, 9, 9], [1, 2, 9], [3, 4, 9]] and x.max_pool2d(2).to_list() == [[4]]
    assert np.allclose(x.cdist(x).to_numpy(), [[0, 8**0.5], [8**0.5, 0]]) and np.allclose(x.correlation_matrix().to_numpy(), np.corrcoef(a))
    stack = Array(np.arange(12.0).reshape(3, 2, 2))
    assert stack.ndim == 3 and np.allclose((stack @ Array(np.eye(2))).to_numpy(), stack.to_numpy()) and np.allclose(stack.transpose().to_numpy(), stack.to_numpy().transpose(0, 2, 1))
    assert np.allclose((stack @ stack).to_numpy(), stack.to_numpy() @ stack.to_numpy())
    assert x.mse_loss(x) == 0 and np.isclose(x.huber_loss(x + 2), 1.5) and Array([[0.0, -1.0]]).signum().to_list() == [[1, -1]]
    with pytest.raises(ValueError):
        Array([[1.0], [1.0, 2.0]])
    with pytest.raises(ValueError):
        Array([[1.0, 2.0], [2.0, 4.0]]).inv()


def test_scalars():
    assert Scalar(9).sqrt() == 3 and Scalar(2.5).round() == 3 and Scalar(-5) % 3 == -2 and Scalar(8).log(2) == 3
    for bad in (lambda: Scalar(-1).sqrt(), lambda: Scalar(0).log(), lambda: Scalar(2).acos(), lambda: Scalar(1).clamp(2, 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ZeroDivisionError):
        Scalar(1) / 0
    assert Complex(3, -4).sqrt() == 2 - 1j and Complex(3, 4).abs() == 5 and Complex(1) < Complex(0, 2)
    d = Dual(2.0, 1.0)
    assert (d * d + d).derivative == 5 and math.isclose(d.gamma().derivative, digamma_value(2.0)) and math.isclose((1 / d).derivative, -0.25)
    assert math.isclose(find_root_newton(lambda x: x * x - 2, 1.0), 2**0.5) and math.isclose(integrate_simpson(math.sin, 0, math.pi), 2, rel_tol=1e-6)
    q = Quaternion(math.cos(math.pi / 4), 0, 0, math.sin(math.pi / 4))
    assert np.allclose(q.rotate_vector([1, 0, 0]), [0, 1, 0]) and math.isclose((q * q).norm(), 1)


def test_distributions(spark):
    assert math.isclose(distributions.Normal().cdf(1.96), 0.9750021, rel_tol=1e-6) and math.isclose(distributions.Normal().ppf(0.975), 1.959964, rel_tol=1e-6)
    t = distributions.StudentT(0, 1, 5)
    assert math.isclose(t.cdf(2.015048), 0.95, rel_tol=1e-5) and math.isclose(t.ppf(0.975), 2.570582, rel_tol=1e-5)
    assert math.isclose(distributions.Poisson(3).cdf(2), 0.4231901, rel_tol=1e-6) and math.isclose(distributions.Exponential(2).ppf(0.5), math.log(2) / 2)
    mean = distributions.Normal(5, 2).sample(spark, 20000, 7).agg(F.avg("x")).first()[0]
    assert abs(mean - 5) < 0.1
    with pytest.raises(ValueError):
        distributions.Normal(0, 0)


def test_geometry_signal(spark):
    assert geometry.hull_of([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 15.0)], "x double, y double")
    assert [r.i for r in df.select(geometry.in_polygon(F.col("x"), F.col("y"), [0, 10, 10, 0], [0, 0, 10, 10]).alias("i")).collect()] == [True, False]
    x = np.array([1.0, 2.0, 3.0, 4.0, 0.5])
    v = Vector(x)
    for mode in ("full", "same", "valid"):
        assert np.allclose([r.x for r in signal.convolve(v.df, [1.0, 0.5, 0.25], mode).orderBy("idx").collect()], np.convolve(x, [1, 0.5, 0.25], mode))
    spectrum = signal.dft(v.df, 5).orderBy("k").collect()
    assert np.allclose([complex(r.re, r.im) for r in spectrum], np.fft.fft(x))
    f = signal.fft(v.df.withColumn("g", F.lit(1)), "g")
    back = signal.fft(f.select("series", F.col("k").alias("idx"), F.struct("re", "im").alias("x")), "series", inverse=True)
    assert np.allclose([r.re for r in back.orderBy("k").collect()], x)


def test_gradients(spark):
    a, b = Tensor([[1.0, 2.0]], True), Tensor([[3.0], [4.0]], True)
    (a @ b).sigmoid().sum().backward()
    s = 1 / (1 + math.exp(-11))
    assert np.allclose(a.grad, np.array([[3, 4]]) * s * (1 - s)) and np.allclose(b.grad, np.array([[1], [2]]) * s * (1 - s))
    for make in (lambda p: SGD(p, 0.1, 0.5), lambda p: Adam(p, 0.1)):
        w = Tensor([5.0], True)
        opt = make([w])
        for _ in range(200):
            opt.zero_grad()
            ((w - 2.0) * (w - 2.0)).sum().backward()
            opt.step()
        assert abs(w.data[0] - 2) < 0.1
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(10)], "x double, y double")
    loss = lambda p: ((e := p["w"] * F.col("x") + p["b"] - F.col("y")) * e)
    value, g = loss_and_gradients(df, loss, {"w": 0.0, "b": 0.0})
    y, x = np.arange(10) * 3.0 + 1, np.arange(10.0)
    assert math.isclose(value, (y**2).mean()) and math.isclose(g["w"], (-2 * x * y).mean()) and math.isclose(g["b"], (-2 * y).mean())
    assert fit(df, loss, {"w": 0.0, "b": 0.0}, 3, 0.01)["w"] > 0.5
    assert isinstance(Node(F.lit(1.0)), Node)


def test_files(spark, tmp_path):
    a = np.arange(12.0).reshape(4, 3)
    x = Array(a)
    files.save(x, f"{tmp_path}/m.dat")
    files.save_bin(x, f"{tmp_path}/m.bin")
    files.save_safetensors(x, f"{tmp_path}/m.st", "w")
    files.write_csv(x, f"{tmp_path}/m.csv", ["a", "b", "c"])
    assert np.allclose(files.load(spark, f"{tmp_path}/m.dat").to_numpy(), a) and np.allclose(files.load_bin(spark, f"{tmp_path}/m.bin", 4, 3).to_numpy(), a)
    assert np.allclose(files.load_safetensors(spark, f"{tmp_path}/m.st", "w").to_numpy(), a)
    back, names = files.read_csv(spark, f"{tmp_path}/m.csv", header=True)
    assert names == ["a", "b", "c"] and np.allclose(back.to_numpy(), a)
    lazy = files.LazyArray.open_bin(spark, f"{tmp_path}/m.bin", 4, 3).mul(2).add(1)
    assert lazy.sum() == (2 * a + 1).sum() and np.allclose(lazy.load_rows(1, 3).to_numpy(), 2 * a[1:3] + 1) and len(list(lazy.chunks(3))) == 2


def test_csv_parts_keep_their_order(spark, tmp_path):
    """A scan takes the largest part first; the matrix must still have its rows in the order of parts and blocks."""
    rows = [[float(k), -float(k)] for k in range(60)]
    for k, (lo, hi) in enumerate([(0, 2), (2, 50), (50, 60)]):
        (tmp_path / f"part-{k:05}.csv").write_text("".join(f"{a},{b}\n" for a, b in rows[lo:hi]))
    assert files.read_csv(spark, str(tmp_path))[0].to_numpy().tolist() == rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert files.read_csv(spark, str(tmp_path))[0].to_numpy().tolist() == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_student_in_whole_arrays(spark):
    """A column of a hundred thousand distinct shares is inverted in arrays, not value by value."""
    student = distributions.StudentT(1, 2, 5)
    df = spark.range(100_000).select(((F.col("id") + 0.5) / 100_000).alias("p"))
    began = time.monotonic()
    off = df.select(F.max(F.abs(student.cdf(student.ppf(F.col("p"))) - F.col("p"))).alias("x")).first().x
    assert off < 1e-9 and time.monotonic() - began < 60
    assert student.ppf(0.0) == -INF and student.ppf(1.0) == INF and abs(student.ppf(0.5) - 1) < 1e-6
    assert abs(distributions.StudentT().cdf(1.0) - 0.75) < 1e-12 and distributions.StudentT().cdf(-INF) == 0
    with pytest.raises(ValueError):
        student.ppf(1.5)
