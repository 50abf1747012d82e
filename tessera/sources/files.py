"""Matrix files: CSV, raw little-endian doubles, a headed binary format and safetensors.

CSV goes through Spark's reader.  The binary forms are read by ranges of rows, each in its own task, from a path or a URI
(file, hdfs, s3, gs) that executors can open; writing streams the rows through the driver, one partition at a time, so a
matrix may be larger than its memory.
"""

import json
import math
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordered
from tessera.operators.matrix import Array

#: The headed format: magic, version byte, dimensions as u16, each size as u64, then doubles (fixed values).
MAGIC, VERSION = b"RMTH", 1


def _opened(path: str, mode: str = "r"):
    """A stream of a path or URI: of bytes to read at any place, or to write."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(at) if mode == "r" else store.open_output_stream(at)


def _write(a: Array, path: str, head: bytes) -> None:
    """head, then the elements by row, as little-endian doubles."""
    with _opened(path, "w") as f:
        f.write(head)
        for r in a.df.orderBy("row_id").select("v").toLocalIterator():
            f.write(struct.pack(f"<{len(r.v)}d", *r.v))


def read_csv(spark: SparkSession, path: str, header: bool = False, bad: float = math.nan) -> tuple[Array, list[str]]:
    """(matrix, column names).  Blank lines are skipped and what is no number becomes `bad`."""
    raw = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    cells = [F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(float(bad))).alias(f"c{i}") for i, c in enumerate(raw.columns)]
    # Ids grow along a scan, but a scan takes parts by size: rows keep their order only within a block of a file.
    at = raw.metadataColumn("_metadata")
    rows = raw.select(*cells, at["file_path"].alias("_f"), at["file_block_start"].alias("_b")).withColumn("_m", F.monotonically_increasing_id())
    return Array(ordered.with_index(rows, "_f", "_b", "_m", name="row_id").select("row_id", F.array(*[f"c{i}" for i in range(len(cells))]).alias("v"))), (raw.columns if header else [])


def write_csv(a: Array, path: str, header=None) -> None:
    """A folder of CSV parts in row order."""
    names = header or [f"c{i}" for i in range(a.ncols)]
    a.df.orderBy("row_id").select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)]).write.mode("overwrite").option("header", header is not None).csv(path)


def _rows(spark: SparkSession, path: str, offset: int, shape, start: int = 0, end: int | None = None, step: int = 65_536) -> Array:
    n, m = math.prod(shape[:-1]), shape[-1]
    end = n if end is None else min(end, n)
    step = max(1, min(step, (1 << 24) // max(1, m)))

    def read(batches):
        import pandas as pd

        for b in batches:
            for k in b["id"]:
                lo, hi = start + k * step, min(start + (k + 1) * step, end)
                with _opened(path) as f:
                    f.seek(offset + lo * m * 8)
                    a = np.frombuffer(f.read((hi - lo) * m * 8), "<f8").reshape(hi - lo, m)
                yield pd.DataFrame({"row_id": np.arange(lo - start, hi - start), "v": list(a)})

    parts = -(-max(0, end - start) // step)
    return Array(spark.range(0, parts, 1, max(1, min(parts, 2000))).mapInPandas(read, "row_id long, v array<double>"), [end - start, *shape[1:]])


def header(path: str) -> tuple[list[int], int] | None:
    """(shape, offset of the data) of a headed file, None of others."""
    with _opened(path) as f:
        head = f.read(7)
        if head[:4] != MAGIC:
            return None
        n = struct.unpack("<H", head[5:7])[0]
        return list(struct.unpack(f"<{n}Q", f.read(8 * n))), 7 + 8 * n


def save(a: Array, path: str) -> None:
    _write(a, path, MAGIC + bytes([VERSION]) + struct.pack("<H", a.ndim) + struct.pack(f"<{a.ndim}Q", *a.shape))


def load(spark: SparkSession, path: str) -> Array:
    found = header(path)
    if not found:
        raise ValueError("no matrix header")
    shape, at = found
    return _rows(spark, path, at, shape)


def save_bin(a: Array, path: str) -> None:
    _write(a, path, b"")


def _bytes_of(path: str) -> int:
    with _opened(path) as f:
        return f.size()


def load_bin(spark: SparkSession, path: str, rows: int, cols: int) -> Array:
    if _bytes_of(path) < 8 * rows * cols:
        raise ValueError("the file is shorter than its shape")
    return _rows(spark, path, 0, [rows, cols])


def save_safetensors(a: Array, path: str, key: str) -> None:
    head = json.dumps({key: {"dtype": "F64", "shape": a.shape, "data_offsets": [0, 8 * a.size]}}).encode()
    _write(a, path, struct.pack("<Q", len(head)) + head)


def load_safetensors(spark: SparkSession, path: str, key: str) -> Array:
    with _opened(path) as f:
        n = struct.unpack("<Q", f.read(8))[0]
        entry = json.loads(f.read(n)).get(key)
    if not entry or entry["dtype"] != "F64":
        raise ValueError(f"no F64 tensor {key!r}")
    return _rows(spark, path, 8 + n + entry["data_offsets"][0], entry["shape"] if len(entry["shape"]) > 1 else [1, *entry["shape"]])


class LazyArray:
    """A matrix file with elementwise steps that one pass applies; nothing is read before load, sum or iteration."""

    def __init__(self, spark: SparkSession, path: str, shape: list[int] | None = None, offset: int = 0):
        self.spark, self.path, self._shape, self._offset, self._steps = spark, path, shape, offset, ()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "LazyArray":
        if path.endswith(".csv"):
            return cls(spark, path)
        try:
            found = header(path)
        except OSError:
            found = None
        if not found:
            raise ValueError("neither CSV nor a headed matrix file")
        return cls(spark, path, *found)

    @classmethod
    def open_bin(cls, spark: SparkSession, path: str, rows: int, cols: int) -> "LazyArray":
        return cls(spark, path, [rows, cols])

    mmap = open_bin

    def _then(self, f) -> "LazyArray":
        out = LazyArray(self.spark, self.path, self._shape, self._offset)
        out._steps = (*self._steps, f)
        return out

    def __getattr__(self, name: str):
        from tessera.functions import ieee

        if name in ("sin", "cos", "exp", "sigmoid", "abs", "sqrt"):
            return lambda: self._then(ieee.ELEMENTWISE[name])
        raise AttributeError(name)

    def add(self, v: float) -> "LazyArray":
        return self._then(lambda x: x + v)

    def mul(self, v: float) -> "LazyArray":
        return self._then(lambda x: x * v)

    def pow(self, v: float) -> "LazyArray":
        return self._then(lambda x: F.pow(x, F.lit(float(v))))

    def _source(self, start: int = 0, end: int | None = None) -> Array:
        if self._shape is None:
            a = read_csv(self.spark, self.path, bad=0.0)[0]
            return a if not start and end is None else a.slice_rows(start, end)
        return _rows(self.spark, self.path, self._offset, self._shape, start, end)

    def _run(self, a: Array) -> Array:
        for f in self._steps:
            a = a._map(f)
        return a

    def peek(self) -> list[int]:
        return self._shape or self._source().shape

    def load(self) -> Array:
        return self._run(self._source())

    execute = load_all = load

    def load_rows(self, start: int, end: int) -> Array:
        return self._run(self._source(start, end))

    def get_row(self, i: int) -> list[float]:
        return self.load_rows(i, i + 1).get_row(0)

    def get_element(self, r: int, c: int) -> float:
        return self.get_row(r)[c]

    def chunks(self, size: int):
        for start in range(0, self.peek()[0], size):
            yield self.load_rows(start, start + size)

    def sum(self) -> float:
        return self.load().sum_all()

    @property
    def shape(self) -> list[int]:
        return self.peek()

    def __repr__(self) -> str:
        return f"LazyArray({self.path!r}, {len(self._steps)} steps)"


class MmapArray(LazyArray):
    """A raw file of doubles of a given shape, read by ranges of rows."""

    @classmethod
    def mmap(cls, spark: SparkSession, path: str, rows: int, cols: int) -> "MmapArray":
        if _bytes_of(path) < 8 * rows * cols:
            raise ValueError("the file is shorter than its shape")
        return cls(spark, path, [rows, cols])


def table(a: Array, names=None) -> DataFrame:
    """The matrix as a table of one column a matrix column."""
    return a.df.select("row_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names or [f"c{i}" for i in range(a.ncols)])])
