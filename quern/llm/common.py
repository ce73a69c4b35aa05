"""Shared parts of the training-data operators: shared scratch tables, vectorised
tokenising and hashing over Arrow buffers, and input preparation.

Tables that several jobs read go to the folder that ``spark.checkpoint.dir`` names,
so that a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship  # noqa: F401  (the operators take it from here)

_own: list[str] = []

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
STEP_BYTES = 2 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = 0x9E3779B97F4A7C15 | 1


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine that names none gets a temporary one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quern-"))
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder, removed when the driver's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(p)
    return system.makeQualified(p).toString()  # with its scheme, whatever the cluster's default is


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of what was written."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    for t in tables:
        discard(spark, t._scratch)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots and back ticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*[named(c) for c in df.columns])


def whole_row(df: DataFrame, row: str = "row") -> DataFrame:
    """The columns of such a struct, as they were."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in df.schema[row].dataType.names])


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one JVM-side pass, used to size partitions."""
    return int(df.agg(F.sum(F.octet_length(named(text_col)))).first()[0] or 0)


def parts(spark: SparkSession, total: int, each: int) -> int:
    """Partitions for total bytes at about `each`, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each), 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[starts:ends]: every eight bytes are mixed with their place in the span, and the
    sum with the length. Equal hashes are a reason to compare, not a proof."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = np.zeros(len(starts), np.uint64)
    at, k = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(at):
        out[at] += mix((eight[starts[at] + 8 * k] & _MASK[np.minimum(size[at] - 8 * k, 8)]) + np.uint64((k + 1) * _P % (1 << 64)))
        k += 1
        at = at[size[at] > 8 * k]
    for i in np.flatnonzero(size > _LONG):
        s, e = int(starts[i]), int(ends[i])
        for lo in range(s, e, STEP_BYTES):
            w = eight[lo : min(e, lo + STEP_BYTES) : 8].copy()
            if lo + 8 * len(w) > e:
                w[-1] &= _MASK[e - lo - 8 * (len(w) - 1)]
            place = np.arange((lo - s) // 8 + 1, (lo - s) // 8 + 1 + len(w), dtype=np.uint64)
            out[i] += mix(w + place * np.uint64(_P)).sum()
    return mix(out + size.astype(np.uint64) * np.uint64(_P))


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items, by doubling; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, width, power = None, 0, h
    step, bit = 1, 1
    while True:
        if n & bit:
            if out is None:
                out, width = power, step
            else:  # longer run first, then what is there
                m = len(h) - (step + width) + 1
                out = power[:m] * np.uint64(pow(_P, width, 1 << 64)) + out[step : step + m]
                width += step
        if width == n:
            return mix(out)
        m = len(power) - step
        power = power[:m] * np.uint64(pow(_P, step, 1 << 64)) + power[step : step + m]
        step, bit = step * 2, bit * 2


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    if len(v) < n:
        return v[:0]
    step, cur = 1, v
    while step * 2 <= n:
        cur = np.minimum(cur[:-step], cur[step:])
        step *= 2
    if step < n:
        cur = np.minimum(cur[: len(v) - n + 1], cur[n - step : n - step + len(v) - n + 1])
    return cur


_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """Texts as one byte array with document bounds; words are runs of bytes other than
    blank and 0x09-0x0D, which never cross a document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        word = ~_white[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, word
        now = np.empty(len(data) + 1, bool)
        now[-1], now[:-1] = False, word
        self.starts = np.flatnonzero(now & (~before | edge))
        self.ends = np.flatnonzero(before & (~now | edge))
        #: of each document, the number of its first word; one more than documents
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary column; null is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `size` bytes of text each; a longer text comes alone."""
    for batch in batches:
        data, bounds = byte_column(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable) -> Callable:
    """A function on batches that gives back what it freed. A Python worker serves the stages after this one too; what
    its allocators hold from here would come on top of what those need."""

    def own(batches):
        give_back()
        yield from run(batches)
        give_back()

    return own


def lean_group(run: Callable) -> Callable:
    """The same for a function on a group's key and table."""

    def own(key, table):
        try:
            return run(key, table)
        finally:
            give_back()

    return own


def numbers(col: pa.Array, null: int = 0) -> np.ndarray:
    return col.fill_null(null).to_numpy(zero_copy_only=False) if col.null_count else col.to_numpy(zero_copy_only=False)


def lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, kind))
