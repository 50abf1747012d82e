"""Module-level functions, complex vectors, long transforms and file methods against NumPy and hand-worked values."""

import math

import numpy as np
import pytest

from tessera.api import calculus, constants, geometry, linalg, nn, scalar, signal, special, stats, vector
from tessera.operators import signal as plans
from tessera.operators.complexvector import ComplexVector
from tessera.operators.matrix import Array
from tessera.operators.vector import Vector
from tessera.sources.files import MmapArray


def test_vectors_and_constants(spark):
    v = vector.arange(1.0, 5.0)
    assert vector.sqrt(v).to_list() == [1, math.sqrt(2), math.sqrt(3), 2] and vector.vsum(v) == 10 and vector.mean(v) == 2.5 and vector.vmax(v) == 4
    assert vector.clamp(v, 2, 3).to_list() == [2, 2, 3, 3] and vector.dot(v, v) == 30 and vector.percentile(v, 50) == 2.5 and vector.is_prime(v) == [False, True, True, False]
    with pytest.raises(ValueError):
        vector.mean(Vector([]))
    assert constants.PI == math.pi and scalar.pi == math.pi and math.isnan(constants.NAN)
    assert v.into_array().to_list() == [[1, 2, 3, 4]]


def test_stats(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 5.0, 4.0, 5.0]
    fit = stats.linear_regression(x, y)
    assert math.isclose(fit["slope"], 0.6) and math.isclose(fit["intercept"], 2.2) and math.isclose(fit["r_squared"], 0.6)
    assert stats.mean(x) == 3 and stats.variance([4.0]) == 0 and stats.mode([1.0, 2.0, 2.0, 3.0]) == 2 and stats.iqr(x) == 2
    assert math.isclose(stats.correlation(x, y), np.corrcoef(x, y)[0, 1]) and stats.correlation(x, [1.0] * 5) == 0
    assert math.isclose(stats.spearman_correlation(x, [5.0, 6.0, 7.0, 8.0, 7.0]), 0.8207826816681233)
    t, df, p = stats.t_test([20.0, 22, 19, 24, 25], [30.0, 29, 35, 32, 31])
    assert math.isclose(t, -6.119, abs_tol=1e-3) and 7 < df < 8.1 and p < 0.002
    f = stats.anova_oneway([[1.0, 2, 3], [], [2.0, 3, 4]])
    assert math.isclose(f[0], 1.5) and f[1:] == (1, 4)
    assert math.isclose(stats.geometric_mean([1.0, 4.0]), 2) and math.isclose(stats.harmonic_mean([1.0, 3.0]), 1.5)
    for bad in (lambda: stats.describe([]), lambda: stats.correlation([1.0], [1.0]), lambda: stats.anova_oneway([[1.0]])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("n", [1, 2, 12, 60, 61, 128])
def test_long_transforms(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(z.real), float(z.imag)) for i, z in enumerate(x)], "idx long, re double, im double")
    for inverse, want in ((False, np.fft.fft(x)), (True, np.fft.ifft(x))):
        # Parts of at most 16 samples: 60 and 128 take four steps, 61 chirps.
        got = plans.long_fft(df, n, inverse, short=8, most_part=16).orderBy("idx").collect()
        assert np.allclose([complex(r.re, r.im) for r in got], want, atol=1e-9)


def test_signal(spark):
    t = np.sin(2 * np.pi * 5 * np.arange(128) / 128)
    mags = signal.rfft(t.tolist()).to_list()
    assert len(mags) == 65 and int(np.argmax(mags)) == 5
    spectrum = signal.fft(t.tolist())
    assert np.allclose(signal.ifft(spectrum).to_list(), t) and np.allclose(signal.fft_styled(t.tolist())[0].to_list(), np.abs(np.fft.fft(t)))
    assert len(signal.fft([])) == 0
    rng = np.random.default_rng(0)
    a, k = rng.normal(size=700), rng.normal(size=600)
    for mode, want in (("full", np.convolve(a, k)), ("valid", np.convolve(a, k, "valid"))):
        assert np.allclose(signal.convolve(a.tolist(), k.tolist(), mode).to_list(), want)
    assert signal.convolve([1.0, 2.0, 3.0], [1.0, 1.0], "same").to_list() == [1, 3, 5]
    c = ComplexVector([3.0, 1.0], [4.0, 0.0])
    assert c.to_mags().to_list() == [5, 1] and c.to_phases()[1] == 0
    c.mask_inplace([True, False])
    assert c.to_list() == [3 + 4j, 0]


def test_geometry_calculus_special(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 6.0, 3.0]
    assert geometry.euclidean_distance(a, b) == 5 and geometry.manhattan_distance(a, b) == 7 and math.isclose(geometry.minkowski_distance(a, b, 2), 5)
    assert geometry.cosine_similarity(a, [0.0] * 3) == 0 and math.isclose(geometry.angle_between([1.0, 0.0], [0.0, 1.0]), math.pi / 2)
    assert geometry.cross_product([1.0, 0, 0], [0.0, 1, 0]).to_list() == [0, 0, 1] and geometry.projection(a, [1.0, 0, 0]).to_list() == [1, 0, 0]
    square = ([0.0, 10, 10, 0], [0.0, 0, 10, 10])
    assert geometry.is_point_in_polygon(5, 5, *square) and not geometry.is_point_in_polygon(15, 15, *square)
    assert sorted(geometry.convex_hull([0.0, 10, 10, 0, 5], [0.0, 0, 10, 10, 5])) == [(0, 0), (0, 10), (10, 0), (10, 10)]
    assert calculus.integrate_trapezoidal([0.0, 1, 3], [0.0, 2, 2]) == 5 and math.isclose(calculus.integrate_simpson_array([0.0, 1, 4], 1.0), 8 / 3)
    with pytest.raises(ValueError):
        calculus.integrate_simpson_array([1.0, 2.0], 1.0)
    assert special.gamma(5) == 24 and special.erf([0.0]) == [0] and special.ln_gamma(Vector([1.0])).to_list() == [0]
    assert special.gamma(Array([[1.0, 2.0], [3.0, 4.0]])).to_list() == [[1, 1], [2, 6]]


def test_networks_and_algebra(spark):
    m = [[1.0, -2.0], [3.0, 4.0]]
    assert nn.relu(m).to_list() == [[1, 0], [3, 4]] and nn.glorot_uniform([4, 3], seed=1).shape == [4, 3] and math.isclose(nn.mse_loss(Array(m), Array(m)), 0)
    assert math.isclose(linalg.det(m), 10) and np.allclose(linalg.gram_matrix(m).to_numpy(), np.array(m).T @ np.array(m))


def test_scalars(spark):
    assert scalar.linspace(0, 1, 3).sum() == 1.5 and scalar.zeros(3).sum() == 0 and scalar.root(-8, 3) == -2 and scalar.round_half_even(2.5) == 2
    assert scalar.is_power_of_two(8) and scalar.next_power_of_two(9) == 16 and scalar.is_prime(97) and math.isclose(scalar.logsumexp2(0, 0), math.log(2))
    with pytest.raises(ValueError):
        scalar.root(-4, 2)


def test_file_methods(spark, tmp_path):
    a = Array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    a.save(f"{tmp_path}/a.mat")
    a.save_bin(f"{tmp_path}/a.bin")
    a.save_csv(f"{tmp_path}/csv", ["p", "q"])
    a.save_safetensors(f"{tmp_path}/a.safetensors", "w")
    assert Array.load(f"{tmp_path}/a.mat").to_list() == a.to_list() and Array.load_safetensors(f"{tmp_path}/a.safetensors", "w").to_list() == a.to_list()
    back, names = Array.load_csv_with_header(f"{tmp_path}/csv")
    assert names == ["p", "q"] and back.to_list() == a.to_list()
    m = MmapArray.mmap(spark, f"{tmp_path}/a.bin", 3, 2)
    assert m.shape == [3, 2] and m.get_element(2, 1) == 6 and [c.shape[0] for c in m.chunks(2)] == [2, 1]
