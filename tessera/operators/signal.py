"""Convolution and Fourier transforms of ordered columns."""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convolve(df: DataFrame, kernel: list[float], mode: str, x: str = "x", idx: str = "idx") -> DataFrame:
    """(idx, x): full, same or valid convolution with a constant kernel.  Each sample adds to len(kernel) outputs, which
    are summed with partial aggregation; nothing depends on one task seeing the whole signal."""
    m = len(kernel)
    if mode not in ("full", "same", "valid"):
        raise ValueError(f"unknown mode {mode!r}")
    taps = F.array(*[F.lit(float(k)) for k in kernel])
    full = df.select(F.col(idx).alias("_i"), F.col(x).alias("_x"), F.posexplode(taps).alias("_j", "_k")).groupBy((F.col("_i") + F.col("_j")).alias("idx")).agg(F.sum(F.col("_x") * F.col("_k")).alias("x"))
    if mode == "full":
        return full
    n = df.agg((F.max(idx) + 1).alias("_n"))
    shift, size = ((m - 1) // 2, F.greatest(F.col("_n"), F.lit(m))) if mode == "same" else (m - 1, F.col("_n") - m + 1)
    shift_c = F.lit(shift) if mode == "same" else F.least(F.col("_n"), F.lit(m)) - 1
    if mode == "same":
        size = F.col("_n")
    return full.crossJoin(F.broadcast(n)).filter((F.col("idx") >= shift_c) & (F.col("idx") < shift_c + size)).select((F.col("idx") - shift_c).alias("idx"), "x")


def dft(df: DataFrame, n: int, x: str = "x", idx: str = "idx") -> DataFrame:
    """(k, re, im) of a short series of n samples, as one aggregate: every sample adds to n frequencies."""
    w = -2 * np.pi / n
    terms = df.select(F.col(idx).alias("_t"), F.col(x).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    # The product of index and frequency is reduced first, so the angle stays exact.
    angle = F.pmod(F.col("_t") * F.col("k"), F.lit(n)) * float(w)
    return terms.groupBy("k").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), F.sum(F.col("_x") * F.sin(angle)).alias("im"))


def fft(df: DataFrame, series: str, x: str = "x", idx: str = "idx", inverse: bool = False) -> DataFrame:
    """(series, k, re, im): the transform of every series, each in one task.  With inverse, x holds structs re, im and re
    is the series again."""

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        v = pdf["re"].to_numpy(float) + 1j * pdf["im"].to_numpy(float)
        out = np.fft.ifft(v) if inverse else np.fft.fft(v)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "k": np.arange(len(out)), "re": out.real, "im": out.imag})

    parts = (F.col(f"{x}.re"), F.col(f"{x}.im")) if inverse else (F.col(x).cast("double"), F.lit(0.0))
    flat = df.select(F.col(series).alias("series"), F.col(idx).cast("long").alias("idx"), parts[0].alias("re"), parts[1].alias("im"))
    return flat.groupBy("series").applyInPandas(one, f"series {df.schema[series].dataType.simpleString()}, k long, re double, im double")


def magnitudes(spectrum: DataFrame) -> DataFrame:
    """spectrum with mag and phase."""
    return spectrum.withColumn("mag", F.hypot("re", "im")).withColumn("phase", F.atan2("im", "re"))


def mask(spectrum: DataFrame, keep) -> DataFrame:
    """spectrum with zeros where the column expression `keep` is false."""
    return spectrum.withColumn("re", F.when(keep, F.col("re")).otherwise(0.0)).withColumn("im", F.when(keep, F.col("im")).otherwise(0.0))


#: One task transforms series of up to SHORT samples whole, and parts of longer ones of up to MOST_PART.
SHORT, MOST_PART = 1 << 16, 1 << 22


def long_fft(df: DataFrame, n: int, inverse: bool = False, short: int = SHORT, most_part: int = MOST_PART) -> DataFrame:
    """(idx, re, im): the transform of one series (idx, re, im) of n samples, missing ones being 0.

    Four steps: with n = a b, the samples of each remainder by a are transformed, turned by their twiddle factors, and
    transformed again across remainders, so a task holds about the root of n samples.  A length whose factors are too
    far apart, such as a large prime, goes through chirps of a power of two (Bluestein).
    """
    a = 1 if n <= short else next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    b = n // a
    if b > max(short, most_part):
        return _chirped(df, n, inverse, short, most_part)
    step, turn = (np.fft.ifft, 2j) if inverse else (np.fft.fft, -2j)

    def part(key: str, size: int, place, twiddle: bool):
        def one(pdf):
            import pandas as pd

            v, k = np.zeros(size, complex), int(pdf[key].iloc[0])
            v[place(pdf["idx"].to_numpy())] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            out, i = step(v), np.arange(size)
            if twiddle:
                out = out * np.exp(turn * np.pi * k * i / n)
            return pd.DataFrame({"idx": i * a + k if twiddle else k + b * i, "re": out.real, "im": out.imag})

        return one

    rows = df.select(F.col("idx").cast("long").alias("idx"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    schema = "idx long, re double, im double"
    first = rows.groupBy((F.col("idx") % a).alias("r"))
    inner = first.applyInPandas(_keyed(part("r", b, lambda t: t // a, True), "r", lambda t: t % a), schema)
    if a == 1:
        return inner
    # Here idx is q a + r: frequency q of the first step, remainder r.
    return inner.groupBy(F.floor(F.col("idx") / a).alias("q")).applyInPandas(_keyed(part("q", a, lambda t: t % a, False), "q", lambda t: t // a), schema)


def _keyed(f, key: str, of):
    """f on a group's rows with the group's key as a column."""
    return lambda pdf: f(pdf.assign(**{key: of(pdf["idx"])}))


def times(x: DataFrame, y: DataFrame) -> DataFrame:
    """(idx, re, im): the products of two spectra."""
    other = y.select("idx", F.col("re").alias("_r"), F.col("im").alias("_i"))
    return x.join(other, "idx").select("idx", (F.col("re") * F.col("_r") - F.col("im") * F.col("_i")).alias("re"), (F.col("re") * F.col("_i") + F.col("im") * F.col("_r")).alias("im"))


def _chirped(df: DataFrame, n: int, inverse: bool, short: int, most_part: int) -> DataFrame:
    m = 1 << (2 * n - 2).bit_length()
    sign = -1.0 if inverse else 1.0
    # Squares are reduced first, so the angle stays exact.
    angle = F.pmod(F.col("idx") * F.col("idx"), F.lit(2 * n)) * (np.pi / n)
    chirp = df.sparkSession.range(n).select(F.col("id").alias("idx")).select("idx", F.cos(angle).alias("re"), (-sign * F.sin(angle)).alias("im"))
    mirrored = chirp.select("idx", "re", (-F.col("im")).alias("im"))
    mirrored = mirrored.unionByName(mirrored.filter("idx > 0").withColumn("idx", F.lit(m) - F.col("idx")))
    bent = times(df.select("idx", "re", "im"), chirp)
    both = times(long_fft(bent, m, False, short, most_part), long_fft(mirrored, m, False, short, most_part))
    out = times(long_fft(both, m, True, short, most_part).filter(F.col("idx") < n), chirp)
    scale = 1 / n if inverse else 1.0
    return out.select("idx", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def convolve_long(a: DataFrame, n: int, b: DataFrame, m: int) -> DataFrame:
    """(idx, x): the full convolution of two series (idx, x) of n and m samples, by transforms of a power of two."""
    size = 1 << (n + m - 2).bit_length()
    spectrum = lambda s: long_fft(s.select("idx", F.col("x").alias("re"), F.lit(0.0).alias("im")), size)
    return long_fft(times(spectrum(a), spectrum(b)), size, inverse=True).filter(F.col("idx") < n + m - 1).select("idx", F.col("re").alias("x"))
