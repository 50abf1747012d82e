"""Convolution and Fourier transforms of vectors."""

from pyspark.sql import functions as F

from tessera.api import as_vector
from tessera.operators import signal as plans
from tessera.operators.complexvector import ComplexVector
from tessera.operators.vector import Vector

__all__ = ["ComplexVector", "convolve", "fft", "fft_styled", "ifft", "rfft"]

#: A kernel of up to so many taps is a constant of the plan; a longer one is multiplied as a spectrum.
MOST_TAPS = 512


def convolve(signal, kernel, mode: str) -> Vector:
    """full, same (as long as the signal) or valid convolution."""
    s, k = as_vector(signal), as_vector(kernel)
    n, m = len(s), len(k)
    if mode not in ("full", "same", "valid"):
        raise ValueError(f"unknown mode {mode!r}")
    if not n or not m or (mode == "valid" and m > n):
        return Vector([])
    full = plans.convolve(s.df, k.to_list(), "full") if m <= MOST_TAPS else plans.convolve_long(s.df, n, k.df, m)
    start, size = {"full": (0, n + m - 1), "same": ((m - 1) // 2, n), "valid": (m - 1, n - m + 1)}[mode]
    return Vector(full.filter((F.col("idx") >= start) & (F.col("idx") < start + size)).select((F.col("idx") - start).alias("idx"), "x"), size)


def fft(data) -> ComplexVector:
    """The whole complex spectrum."""
    v = as_vector(data)
    if not len(v):
        return ComplexVector([], [])
    return ComplexVector(plans.long_fft(v.df.select("idx", F.col("x").alias("re"), F.lit(0.0).alias("im")), len(v)), size=len(v))


def ifft(spectrum: ComplexVector) -> Vector:
    """The real part of the inverse transform."""
    n = len(spectrum)
    return Vector(plans.long_fft(spectrum.df, n, inverse=True).select("idx", F.col("re").alias("x")), n) if n else Vector([])


def fft_styled(data) -> tuple[Vector, Vector]:
    """(magnitudes, phases)."""
    found = fft(data)
    return found.to_mags(), found.to_phases()


def rfft(data) -> Vector:
    """The magnitudes of the first n // 2 + 1 frequencies."""
    mags = fft(data).to_mags()
    return mags.head(len(mags) // 2 + 1)
