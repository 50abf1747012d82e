"""Pieces that several operators share: lineage cuts, exact random draws and vectorised word hashing."""

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import stored as cut  # noqa: F401

#: A word, in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def release(spark: SparkSession) -> None:
    """Let the driver find finished shuffles that nothing refers to: executors then delete their files."""
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches small, in rows and in bytes: documents and their shingle sets can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id) -> F.Column:
    """True for the third of documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def constant_array(values) -> F.Column:
    """An array of longs; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def passing(wanted: DataFrame, key: str, words: int = 1 << 14) -> F.Column:
    """A test of a long column `key` that all keys of wanted pass, and few others while they are fewer than 60 * words.

    The bit map has a fixed size whatever the input: the driver gets `words` longs at most.
    """
    word = F.pmod(key, F.lit(words)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(key, 20), F.lit(63)).cast("int"))
    found = {r.w: r.m for r in wanted.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("m")).collect()}
    return F.get(constant_array([found.get(w, 0) for w in range(words)]), word).bitwiseAND(bit) != 0


# Exact draws on the driver -------------------------------------------------------------------------------------------


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw by inversion outwards from the mode; expected steps are of the order of the standard deviation."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))

    def ln_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(ln_choose(good, mode) + ln_choose(bad, draws - mode) - ln_choose(good + bad, draws))
    u, left, right, pl, pr = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
        if pl < 1e-300 and pr < 1e-300:
            break
    return mode


def matrix_with_margins(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """A random contingency table: row i holds rows[i] balls dealt without replacement from columns (equal sums)."""
    left, out = list(columns), []
    for want in rows:
        total, row = sum(left), []
        for c in left:
            got = hypergeometric(rng, c, total - c, want)
            row.append(got)
            total -= c
            want -= got
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


# Words of many texts at once -----------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["p"], _POWERS["i"]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of an Arrow string column; a null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, piece: int = 1 << 18):
    """For each text: (hashes of its words as uint64, starts, ends as byte positions in data).

    Works through the bytes in pieces of about `piece` bytes that end between texts, or between words inside a long
    text, so memory beyond the result is bounded.  A word's hash is a polynomial of its bytes, scrambled.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = i + 1
        if offsets[j] - offsets[i] > piece:
            parts, at, stop = [], int(offsets[i]), int(offsets[j])
            while at < stop:
                to = min(at + piece, stop)
                while to < stop and not _SPACE[data[to]]:
                    to += 1
                parts.append(_piece(data, at, to, np.array([at, to]), lower))
                at = to
            yield tuple(np.concatenate([p[k] for p in parts]) for k in range(3))
            i = j
            continue
        while j < n and offsets[j + 1] - offsets[i] <= piece:
            j += 1
        h, s, e, cuts = *(whole := _piece(data, int(offsets[i]), int(offsets[j]), offsets[i : j + 1], lower)), np.searchsorted(whole[1], offsets[i : j + 1])
        for k in range(j - i):
            yield h[cuts[k] : cuts[k + 1]], s[cuts[k] : cuts[k + 1]], e[cuts[k] : cuts[k + 1]]
        i = j


def _piece(data, lo: int, hi: int, edges: np.ndarray, lower: bool):
    buf = data[lo:hi]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    word = ~_SPACE[buf]
    first, last = word.copy(), word.copy()
    at = (edges - lo)[(edges > lo) & (edges < hi)]
    first[1:] &= ~word[:-1]
    first[at] = word[at]
    last[:-1] &= ~word[1:]
    last[at - 1] = word[at - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(((_LOWER[buf] if lower else buf).astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    h = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    return h, s + lo, e + lo


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The set (sorted distinct hashes) of n-word windows; of a shorter text, its whole sequence; of no words, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    acc = mix64(words[: len(words) - k + 1] + np.uint64(k))
    for d in range(1, k):
        acc = mix64(acc * np.uint64(0x2545F4914F6CDD1D) + words[d : len(words) - k + 1 + d])
    return np.unique(acc)
